import hashlib

from helpers import components, contained, kept_words

import corpus_pipeline
from marlstone.llm import cluster, quality_rules


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, sf).cache()
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    one = stages[1](spark, good, sf).cache()
    comp = components([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in one.collect()} == {d for d, (_, c) in comp.items() if c == d}
    cut = stages[2](spark, one, sf).cache()
    want = {d: k for d, k in kept_words([(r.doc_id, r.text) for r in one.collect()]).items() if k}
    got = {r.doc_id: r for r in cut.collect()}
    assert {d: r.text.split() for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert cut.columns == docs.columns
    clean = stages[3](spark, cut, sf).cache()
    bad = {d for d, _ in contained([(d, r.text) for d, r in got.items()], items)}
    assert {r.doc_id for r in clean.collect()} == set(got) - bad
    packed = stages[4](spark, clean, sf)
    assert {r.doc_id for r in packed.collect()} == set(got) - bad
    assert {tuple(r)[:4] for r in corpus_pipeline.run(spark, sf).collect()} and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_rows_and_not_ids(spark, tmp_path):
    """Ids that several texts share, texts without an id, repeated rows, nulls, and columns of clashing names."""
    a, c, x = (" ".join(f"{k}{i}" for i in range(80)) for k in "acx")
    item = "the item of the benchmark has nine words here"
    rows = [(0, a), (1, a), (1, c), (2, x), (2, x), (2, f"{x} {item}"), (None, c), (None, x + " more of it"), (None, "no id " + item), (7, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "o", "n") for r in rows], "doc_id long, text string, old_id string, row_id string").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    kept = sorted(map(str, ((r.doc_id, (r.text or "")[:2], len(r.text or "")) for r in one.collect())))
    assert one.columns == docs.columns
    least = min((x, f"{x} {item}"), key=lambda t: hashlib.md5(t.encode()).hexdigest())  # of two linked texts with one id
    assert kept == sorted(map(str, [(0, a[:2], len(a)), (1, c[:2], len(c)), *[(2, x[:2], len(least))] * (2 if least == x else 1), (None, "no", len("no id " + item)), (7, "", 0), (8, "", 0), (None, "", 0)]))
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(str(r) for r in rows if item not in (r[1] or ""))
    wide = [(2**63 - 1, a), (2**63 - 1, c), (2**63 - 2, c), (None, item)]
    rows, row = cluster.with_row_ids(spark.createDataFrame(wide, "doc_id long, text string"))
    assert len({r[row] for r in rows.collect()}) == 4 and {r[row] for r in rows.collect()} >= {2**63 - 1, 2**63 - 2}
    empty = docs.limit(0)
    assert all(f(spark, empty, str(tmp_path)).collect() == [] for f in stages.values())


def test_entry_lists_all_operators(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
