"""Queries that read every row of their tables, without filters by id."""

from marlstone.plans import registry

QUERIES = registry.queries()


def test_two_key_dedup_reads_all_ids(spark, tmp_path):
    rows = [(0, "base", "s", 4), (1, "base", "t", 4), (2, "new", "s", 3), (3, "other", "s", 4), (4, "new", "t", 3), (6, "last", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in QUERIES["s_ddp_07_two_key_dedup"](spark, str(tmp_path)).collect()) == [2, 6]


def test_append_and_gold_letters_keep_all_rows(spark, sf):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES["s_set_02_append"](spark, sf).collect()) == ids
    got = {r.question_id: r.letter for r in QUERIES["s_fn_22_any_gold_letter"](spark, sf).collect()}
    assert sorted(got) == sorted(f"q{i}" for i in ids) and None not in got.values()


def test_grams_and_csv_reach_past_the_first_words(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(100))
    text = f'{words}\n"quoted", end'
    spark.createDataFrame([(0, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("s_sim_02_word_grams_cased", "s_sim_04_mixed_grams"):
        assert "w96 w97 w98 w99" in QUERIES[name](spark, str(tmp_path)).first().g
    assert QUERIES["s_src_07_csv"](spark, str(tmp_path)).first().text == text
