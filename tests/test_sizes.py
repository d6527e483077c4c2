"""Queries of similarity and their parts on rows that the small tables lack."""

import random

import duckdb
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from marlstone.operators import dedup, similarity
from marlstone.plans import pipelines, registry


def test_build_stage_gives_every_text_as_its_sql_does(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    docs = [(0, item, "fr", "s", 1), (1, item, "en", "s", 1), (2, "a b c d e f", "de", "s", 1), (3, "a b c d e f", None, "s", 1), (4, "only here and nowhere else", None, "s", 1), (5, None, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "s_pip_04_build_stage"
    assert spark_rows(registry.queries()[name](spark, str(tmp_path))) == duck_rows(con, registry.oracle_sql()[name])


ODD = ["", " ", "a", "A b", "a b\tc", "a b c d", "a b c d e", "  x_y  z-1 \u00c9t\u00e9 \u0130x ", "a a a a a a", "\u4f60\u597d 12 \u00bd\u0301 w", None, "q\u00a0r s t u", "it's a, b; c\x0bd\x0ce", "x" * 100, "a b c d e" * 40]


@pytest.mark.parametrize("kind, short", [("lower", "empty"), ("cased", "whole"), ("cased", "empty"), ("adaptive", "empty")])
def test_gram_sets_are_the_sets_of_the_gram_functions(spark, kind, short):
    made = similarity.adaptive_grams(F.col("text")) if kind == "adaptive" else similarity.word_grams(F.col("text"), lower=kind == "lower", short=short)
    rows = spark.createDataFrame(list(enumerate(ODD)), "key long, text string")
    want = {r.key: set(r.grams) for r in rows.select("key", made.alias("grams")).collect()}
    got = {r.key: r.ids for r in similarity.gram_sets(rows, F.col("text"), kind, short).collect()}
    assert all(len(set(v)) == len(v) for v in got.values())
    assert {(a, b): len(want[a] & want[b]) for a in want for b in want} == {(a, b): len(set(got[a]) & set(got[b])) for a in got for b in got}


def _sets(seed):
    """Near copies of some sets, an element that nearly all have, small and empty sets, copies."""
    rng, sets = random.Random(seed), []
    for k in range(120):
        own = [f"{k % 100}-{i}" for i in range(rng.choice((1, 2, 3, 9, 40)))] + ["all"] * (k % 10 > 0)
        sets.append(own)
        sets += [[f"n{rng.random()}" if rng.random() < share else x for x in own] for share in (0.05, 0.15, 0.3) if k % 4 == 0]
    return [(i, sorted(set(s))) for i, s in enumerate([*sets, [], [], sets[0]])]


@pytest.mark.parametrize("lot", [7, 1_000_000])
def test_every_set_that_shares_enough_is_told(spark, monkeypatch, lot):
    rows = _sets(lot)
    monkeypatch.setattr(similarity, "LOT", lot)
    of = {}
    for k, s in rows:
        for x in s:
            of.setdefault(x, []).append(k)
    sets = similarity.with_ids(spark.createDataFrame(rows, "key long, grams array<string>").repartition(3))
    for percent in (50, 70):
        want = {k for k, s in rows if s and 100 * sum(len(of[x]) > 1 for x in s) >= percent * len(s)}
        assert {r.key for r in similarity.sharing(sets, percent).collect()} == want


def test_only_rows_that_can_be_near_are_kept_and_shuffled_whole(spark, monkeypatch):
    seen, real = [], dedup.rare_prefixes
    monkeypatch.setattr(dedup, "rare_prefixes", lambda sets, percent: seen.append(sets.count()) or real(sets, percent))
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(50)]
    texts += [texts[0] + " more", texts[1], "short one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    sets = lambda r: similarity.gram_sets(r, F.col("text"))
    got = {r.key: r.near for r in dedup.near_duplicates(rows, 70, sets=sets).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {50: 0, 51: 1} and len(got) == 53
    assert seen == [3]  # two pairs of which one is of equal sets


def test_merge_keeps_and_counts_rows_as_a_pass_in_order_does(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(6)]
    texts += [texts[0] + " more", texts[1], texts[2] + " item", "", None]
    train = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "key long, source string, text string")
    out = pipelines.merge(train, spark.createDataFrame([(0, texts[2])], "key long, text string"), F.col("text"))
    assert sorted(r.key for r in out["kept"].collect()) == [0, 1, 3, 4, 5, 9, 10]
    assert out["kept"].columns == train.columns
    assert tuple(out["totals"].first()) == (11, 2, 2, 7)


@pytest.mark.parametrize("name", ["s_sim_08_lsh_candidates", "s_sim_09_estimated_jaccard"])
def test_signatures_are_made_once(spark, sf, name):
    assert "MapInArrow" not in registry.queries()[name](spark, sf)._jdf.queryExecution().toString()


def test_the_kept_index_has_each_set_once_and_gives_all_copies(spark, tmp_path, monkeypatch):
    from marlstone.operators.lsh_index import LshIndex

    seen, real = [], LshIndex.insert
    monkeypatch.setattr(LshIndex, "insert", lambda self, rows: seen.append(rows.count()) or real(self, rows))
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    texts += [texts[0].upper()] * 5 + [texts[1] + " more", texts[0] + " more", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in (0, 4, 9, 11)], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "s_sim_08_kept_index"
    got = spark_rows(registry.queries()[name](spark, str(tmp_path)))
    assert got == duck_rows(con, registry.oracle_sql()[name]) and len(got[1]) == 13
    assert seen[-1] == 6
