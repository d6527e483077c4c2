"""Queries of sampling, permutation and reweighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import sampling as smp
from marlstone.plans.fixtures import MCQ_SQL, RESULTS_SQL, documents, mcq, options, results
from marlstone.plans.registry import query


def _h(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key})"


def _u(key: str, seed: int = 42) -> str:
    return f"(('0x' || left(md5('{seed}|' || {key}), 8))::BIGINT / 4294967296.0)"


@query("s_smp_01_sample", f"SELECT doc_id FROM documents ORDER BY {_h('doc_id')}, doc_id LIMIT 50")
def _(spark, d):
    return smp.sample(documents(spark, d), 50, "doc_id").select("doc_id")


@query("s_smp_02_shuffle", f"SELECT doc_id, lang FROM documents ORDER BY {_h('doc_id')}, doc_id")
def _(spark, d):
    return smp.shuffle(documents(spark, d).select("doc_id", "lang"), "doc_id")


@query("s_smp_03_per_stratum", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_h('doc_id')}, doc_id) <= 5")
def _(spark, d):
    return smp.per_stratum(documents(spark, d), "source", 5, "doc_id").select("doc_id", "source")


@query("s_smp_04_per_stratum_valid", f"SELECT doc_id, source FROM documents WHERE n_chars >= 1000 QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_h('doc_id')}, doc_id) <= 5")
def _(spark, d):
    return smp.per_stratum_valid(documents(spark, d), F.col("n_chars") >= 1000, "source", 5, "doc_id").select("doc_id", "source")


@query("s_smp_05_even_budget", f"SELECT doc_id FROM (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_h('doc_id')}, doc_id) <= greatest(1, 42 // (SELECT count(DISTINCT lang) FROM documents))) ORDER BY {_h('doc_id', 43)}, doc_id LIMIT 42")
def _(spark, d):
    return smp.even_budget(documents(spark, d), "lang", 42, "doc_id").select("doc_id")


@query("s_smp_06_even_budget_floor", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_h('doc_id')}, doc_id) <= greatest(5, 40 // (SELECT count(DISTINCT source) FROM documents))")
def _(spark, d):
    return smp.even_budget(documents(spark, d), "source", 40, "doc_id", floor=5, cap=False).select("doc_id")


@query("s_smp_07_proportional", "SELECT 100::BIGINT AS n, count(DISTINCT lang) AS strata FROM documents")
def _(spark, d):
    """The repaired quotas add up to n and leave no stratum out; tests compare them one by one."""
    return smp.proportional(documents(spark, d), "lang", 100, "doc_id").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("strata"))


@query("s_smp_08_error_samples", f"SELECT question_id, task FROM {RESULTS_SQL} WHERE model = 'm0' AND protocol = 'direct' AND NOT correct QUALIFY row_number() OVER (PARTITION BY task ORDER BY {_h('question_id', 7)}, question_id) <= 3")
def _(spark, d):
    wrong = results(spark, d).where("model = 'm0' AND protocol = 'direct' AND NOT correct")
    return smp.per_stratum(wrong, "task", 3, "question_id", seed=7).select("question_id", "task")


_HEX = "CAST('0x' || left(md5({}), 15) AS BIGINT)"  # what sampling.below takes


@query(
    "s_smp_09_references",
    f"""WITH pool AS (SELECT doc_id AS ref, row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) - 1 AS place FROM documents WHERE lang = 'fr'), n AS (SELECT greatest(1, count(*)) AS n FROM pool),
asks AS (SELECT doc_id, CAST(i AS INT) AS i, {_HEX.format("'43|' || doc_id || '|' || i")} % n AS place FROM documents, range(0, 4) t(i), n) SELECT doc_id, i, ref FROM asks LEFT JOIN pool USING (place)""",
)
def _(spark, d):
    docs = documents(spark, d)
    return smp.references(docs, docs.where("lang = 'fr'").select(F.col("doc_id").alias("ref")), 4, "doc_id", "ref")


_PERM = "list_transform(list_sort(list_transform(range(0, 4), lambda i: {'h': md5('42|' || question_id || '|' || i), 'i': i})), lambda s: s.i)"


@query("s_smp_10_permute_options", f"SELECT question_id, list_transform(p, lambda i: o[i + 1]) AS options, chr(CAST(64 + list_position(p, ascii(gold) - 65) AS INT)) AS gold FROM (SELECT question_id, gold, [opt_a, opt_b, opt_c, opt_d] AS o, {_PERM} AS p FROM {MCQ_SQL})")
def _(spark, d):
    return smp.permute_options(options(mcq(spark, d)), "question_id").select("question_id", "options", "gold")


@query("s_smp_11_permute_prompt", f"SELECT question_id, 'Which one?' || chr(10) || array_to_string(list_transform(range(0, 4), lambda k: chr(CAST(65 + k AS INT)) || '. ' || o[p[k + 1] + 1]), chr(10)) AS prompt, chr(CAST(64 + list_position(p, ascii(gold) - 65) AS INT)) AS gold FROM (SELECT question_id, gold, [source, language, task, gold] AS o, {_PERM} AS p FROM {MCQ_SQL})")
def _(spark, d):
    rows = mcq(spark, d)
    line = lambda x, c: F.concat(F.lit(f"\n{x}"), F.col(c))
    rows = rows.withColumn("prompt", F.concat(F.lit("Which one?"), line("A． ", "source"), line("B、", "language"), line("C: ", "task"), line("D. ", "gold")))
    return smp.permute_prompt(rows, "question_id").select("question_id", "prompt", "gold")


_WRONG = _PERM.replace("range(0, 4)", "range(0, 3)")


@query("s_smp_12_constant_distractors", f"SELECT question_id, list_transform(p, lambda i: o[i + 1]) AS options, chr(CAST(64 + list_position(p, 0) AS INT)) AS gold FROM (SELECT question_id, [source, 'yes', 'no'] AS o, {_WRONG} AS p FROM {MCQ_SQL})")
def _(spark, d):
    return smp.with_distractors(mcq(spark, d).drop("gold"), "source", F.array(F.lit("yes"), F.lit("no")), "question_id").select("question_id", "options", "gold")


@query("s_smp_13_add_none_option", f"SELECT question_id, list_transform(p, lambda i: o[i + 1]) AS options, chr(CAST(64 + list_position(p, doc_id % 3) AS INT)) AS gold FROM (SELECT question_id, doc_id, [source, language, task, 'None of the above'] AS o, {_PERM} AS p FROM {MCQ_SQL})")
def _(spark, d):
    rows = mcq(spark, d).withColumn("options", F.array(F.col("source"), F.col("language"), F.col("task"), F.lit("None of the above"))).withColumn("gold", F.char(F.col("doc_id") % 3 + 65))
    return smp.permute_options(rows, "question_id").select("question_id", "options", "gold")


@query(
    "s_smp_14_pool_distractors",
    f"""WITH q AS (SELECT question_id, opt_b AS answer FROM {MCQ_SQL}), pool AS (SELECT ref, row_number() OVER (ORDER BY md5('42|' || ref), ref) - 1 AS place FROM (SELECT DISTINCT answer AS ref FROM q WHERE trim(answer) <> '')), n AS (SELECT greatest(1, count(*)) AS n FROM pool),
asks AS (SELECT question_id, answer, i, ({_HEX.format("'43|' || question_id")} + i) % n AS place FROM q, n, range(0, 4) t(i) WHERE i <= least(3, n - 1)),
d AS (SELECT question_id, list(ref ORDER BY i) AS r FROM asks JOIN pool USING (place) WHERE ref <> answer GROUP BY question_id)
SELECT question_id, answer, list_concat(coalesce(r, []), ['None of these (1)', 'None of these (2)', 'None of these (3)'])[1:3] AS wrong FROM q LEFT JOIN d USING (question_id)""",
)
def _(spark, d):
    return smp.pool_distractors(mcq(spark, d).select("question_id", F.col("opt_b").alias("answer")), "answer", "question_id")


@query("s_smp_15_mined_distractors")
def _(spark, d):
    return mcq(spark, d).select("question_id", smp.mined_distractors(F.col("story"), F.col("opt_a")).alias("wrong"))


@query("s_smp_16_difficulty", f"SELECT question_id, CASE WHEN r >= 0.75 THEN 'easy' WHEN r >= 0.25 THEN 'medium' ELSE 'hard' END AS bucket FROM (SELECT question_id, avg(correct::INT) AS r FROM {RESULTS_SQL} GROUP BY question_id)")
def _(spark, d):
    r = results(spark, d).groupBy("question_id").agg(F.avg(F.col("correct").cast("int")).alias("r"))
    return r.select("question_id", smp.difficulty(F.col("r")).alias("bucket"))


@query("s_smp_17_multiplier", f"SELECT task, least(2.0, greatest(0.7, 2.0 - (avg(correct::INT) - 0.5) * 3.25)) AS m FROM {RESULTS_SQL} GROUP BY task")
def _(spark, d):
    return results(spark, d).groupBy("task").agg(F.avg(F.col("correct").cast("int")).alias("a")).select("task", smp.multiplier(F.col("a")).alias("m"))


@query("s_smp_18_replicate", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(range(0, CAST(floor(m) AS INT) + CASE WHEN {_u('doc_id')} < m - floor(m) THEN 1 ELSE 0 END)) FROM (SELECT doc_id, 0.7 + (doc_id % 4) * 0.4 AS m FROM documents)) GROUP BY doc_id")
def _(spark, d):
    rows = documents(spark, d).select("doc_id", (F.lit(0.7) + (F.col("doc_id") % 4) * 0.4).alias("m"))
    return smp.replicate(rows, F.col("m"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("s_smp_19_generation_plan", "WITH k AS (SELECT DISTINCT source AS kind FROM documents), l AS (SELECT DISTINCT lang AS language FROM documents) SELECT kind, language, CAST(i AS INT) AS i, substr('ABCD', CAST(i % 4 + 1 AS INT), 1) AS gold FROM k, l, range(0, (SELECT count(*) FROM documents) // ((SELECT count(*) FROM k) * (SELECT count(*) FROM l))) t(i)")
def _(spark, d):
    """As many questions as documents, for the corpus' sources and languages."""
    docs = documents(spark, d)
    kinds, languages = (sorted(r[0] for r in docs.select(c).distinct().collect()) for c in ("source", "lang"))
    return smp.generation_plan(spark, kinds, languages, docs.count())


@query("s_smp_20_take_valid", f"SELECT doc_id FROM documents WHERE n_chars > 300 ORDER BY {_h('doc_id', 5)}, doc_id LIMIT 30")
def _(spark, d):
    return smp.take_valid(documents(spark, d), F.col("n_chars") > 300, 30, "doc_id", seed=5).select("doc_id")


@query("s_smp_21_pick", f"SELECT doc_id, ['Ann', 'Bo', 'Cy'][CAST(floor({_u('doc_id', 9)} * 3) + 1 AS INT)] AS name FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", smp.pick(["Ann", "Bo", "Cy"], 9, F.col("doc_id")).alias("name"))
