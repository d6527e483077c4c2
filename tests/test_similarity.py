"""Searches against brute force: best matches, kept LSH index, one-permutation signatures, prefixes."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import best_match, dedup, similarity
from marlstone.operators.lsh_index import LshIndex


def test_signatures_estimate_within_theory():
    rng, k, errors = np.random.default_rng(1), 128, {}
    for n in (20, 100, 1000):
        for share in (0.2, 0.5, 0.8):
            both = int(n * share)
            found = []
            for _ in range(150):
                h = rng.integers(-(2**63), 2**63 - 1, 2 * n - both, dtype=np.int64)
                a, b = similarity.one_permutation([h[:n], h[n - both :]], k)
                found.append((a == b).mean())
            j = both / (2 * n - both)
            errors[n, share] = np.mean(found) - j, np.mean((np.array(found) - j) ** 2) / (j * (1 - j) / k)
            assert abs(errors[n, share][0]) < 0.02
    assert all(e[1] < 1.4 for (n, _), e in errors.items() if n >= 1000)  # full bins: as k independent permutations
    assert (similarity.one_permutation([np.zeros(0, np.int64)], 4) == 0).all()


def test_a_kept_index_is_probed_in_place(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"), similarity.adaptive_grams(F.col("text")).alias("grams"))
    rows = rows.union(spark.createDataFrame([(10**6, []), (10**6 + 1, None)], "key long, grams array<string>")).cache()
    signed, name = similarity.minhash(rows).cache(), f"i{uuid.uuid4().hex}"
    index = LshIndex(spark, name, str(tmp_path), buckets=4)
    index.insert(signed.where("key % 3 = 0"))
    index.insert(signed.where("key % 3 < 2"))
    index.drop()
    index = LshIndex(spark, name, str(tmp_path), buckets=4)  # opened again from its files
    index.insert(signed)
    assert index._table("signatures").count() == signed.where("signature IS NOT NULL").count()
    got = {(r.query, r.hit): r.estimate for r in index.probe(signed).collect()}
    assert got == {(r.query, r.hit): r.estimate for r in similarity.lsh_candidates(signed, signed, 0.5).collect()}
    sets = {r.key: set(r.grams or ()) for r in rows.collect()}
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a != b and sets[a] and sets[b]}
    near = {p: j for p, j in near.items() if j >= 0.7}
    assert len(near) > 10 and sum(p in got for p in near) >= 0.9 * len(near)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = index.probe(signed.limit(5))._jdf.queryExecution().executedPlan().toString()
        for table in ("bands", "signatures"):
            scan = next(i for i, line in enumerate(plan.splitlines()) if f"{name}_{table}" in line)
            above = plan.splitlines()[scan - 5 : scan]
            assert not any("Exchange" in x for x in above[-3:]), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    index.drop()


def sets_of(rng, n, common):
    """Sets of which some are near copies or parts of others, with elements that very many of them share."""
    out = []
    for i in range(n):
        s = {rng.randrange(10**6) for _ in range(rng.randrange(0, 40))}
        if out and rng.random() < 0.4:
            s = {x for x in out[rng.randrange(len(out))] if rng.random() < 0.8} | set(list(s)[:3])
        out.append(s | {x for x in common if rng.random() < 0.6})
    return out


@pytest.mark.parametrize("percent,inclusive", [(60, True), (60, False), (20, True), (1, True)])
def test_search_is_exact(percent, inclusive, monkeypatch):
    rng = random.Random(percent)
    for first, common in ((512, []), (4, list(range(15))), (1, list(range(4)))):
        monkeypatch.setattr(best_match, "FIRST", first)
        sets = sets_of(rng, 150, common)
        index = best_match.SetIndex(list(range(150)), [np.array(sorted(s), np.int64) for s in sets])
        for q in [*sets[:40], *({x for x in s if rng.random() < 0.7} | {rng.randrange(10**6)} for s in sets[40:120]), set()]:
            j = {i: len(q & s) / len(q | s) for i, s in enumerate(sets) if q & s}
            over = {i: v for i, v in j.items() if (100 * len(q & sets[i]) >= percent * len(q | sets[i]) if inclusive else 100 * len(q & sets[i]) > percent * len(q | sets[i]))}
            ids = np.array(list(q), np.int64)
            top_j, top_c, hits, values = index.search(ids, percent, inclusive, True)
            assert top_j == max(j.values(), default=0.0) and top_c == max((len(q & sets[i]) / len(sets[i]) for i in j), default=0.0)
            assert dict(zip(hits.tolist(), values.tolist(), strict=True)) == over
            _, _, hits, values = index.search(ids, percent, inclusive, False)
            assert dict(zip(hits.tolist(), values.tolist(), strict=True)) == over


def test_frequent_elements_are_not_opened():
    """A query that equals a set: lists of what all sets share stay closed."""
    rng = random.Random(3)
    sets = [np.array(sorted({*range(30), *(1000 + rng.randrange(10**9) for _ in range(50))}), np.int64) for _ in range(3000)]
    index = best_match.SetIndex(list(range(3000)), sets)
    read = []

    class Noted(np.ndarray):
        def __getitem__(self, at):
            out = super().__getitem__(at)
            if isinstance(at, slice):
                read.append(len(out))
            return out

    index.lists = index.lists.view(Noted)
    top, _, hits, _ = index.search(sets[7], 60, True, True)
    assert top == 1.0 and hits.tolist() == [7] and sum(read) < 3000 * 30 / 10


def test_leakage_over_several_indexes(spark, monkeypatch):
    monkeypatch.setattr(best_match, "BLOCK_GRAMS", 300)
    rng = random.Random(9)
    sets = sets_of(rng, 60, [1, 2])
    train = spark.createDataFrame([(f"t{i}", [str(x) for x in s]) for i, s in enumerate(sets[:30])], "key string, grams array<string>")
    ev = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets[20:])], "key long, grams array<string>")
    got = {r.key: (r.max_jaccard, r.max_containment, r.leaked, r.first_hit) for r in dedup.leakage(train, ev, 30).collect()}
    want = {}
    for i, q in enumerate(sets[:30]):
        j = [len(q & s) / len(q | s) if q | s else 0.0 for s in sets[20:]]
        hits = [k for k, s in enumerate(sets[20:]) if q & s and 100 * len(q & s) >= 30 * len(q | s)]
        want[f"t{i}"] = (max(j), max(len(q & s) / len(s) if s else 0.0 for s in sets[20:]), bool(hits), min(hits, default=None))
    assert got == want
    assert dedup.leakage(train, ev.limit(0), 30).where("max_jaccard > 0 OR leaked").count() == 0 and dedup.leakage(train.limit(0), ev, 30).collect() == []


def test_prefixes_by_several_automata(spark, monkeypatch):
    monkeypatch.setattr(dedup, "AUTOMATON_CHARS", 40)
    texts = {1: "the first story is told here", 2: "a 日本語 story", 3: None, 4: "", 5: "e"}
    items = {10: "story", 11: "日本", 12: "told here", 13: "the first story is told here and more", 14: "", 15: None, 16: "e", 17: "story"}
    train = spark.createDataFrame(list(texts.items()), "key long, text string")
    ev = spark.createDataFrame(list(items.items()), "key long, text string")
    got = {tuple(r) for r in dedup.prefix_leaks(train, ev, 20).collect()}
    assert got == {(i, k) for k, t in texts.items() for i, x in items.items() if t and x and x[:20] in t}
    assert dedup.prefix_leaks(train, ev.limit(0)).collect() == []
    plan = dedup.prefix_leaks(train, ev, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
