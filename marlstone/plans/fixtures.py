"""Tables derived from the driver's by integer arithmetic, in DataFrame form and as SQL, so that both engines agree.

They are synthetic: the driver has no question set, evaluation results or training log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS, PROTOCOLS = 3, ("direct", "cot", "vote")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Four-option questions with whole documents as stories and their first words as options.
MCQ_SQL = r"""(SELECT doc_id, 'q' || doc_id AS question_id, source, lang AS language, 'task' || (doc_id % 5) AS task, t AS story,
 'Which word comes ' || (doc_id % 3) || '?' AS question, coalesce(w[1], '') AS opt_a, coalesce(w[2], '') AS opt_b, coalesce(w[3], '') AS opt_c, coalesce(w[4], '') AS opt_d,
 chr(CAST(65 + doc_id % 4 AS INT)) AS gold FROM (SELECT *, string_split(regexp_replace(coalesce(text, ''), '[ \n\r\t]+', ' ', 'g'), ' ') AS w, coalesce(text, '') AS t FROM documents))"""


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    w = F.split(F.regexp_replace(t, r"[ \n\r\t]+", " "), " ")
    d = documents(spark, sf_dir).select("doc_id", "source", F.col("lang").alias("language"), t.alias("t"), w.alias("w"))
    opts = [F.coalesce(F.get("w", F.lit(i)), F.lit("")).alias(f"opt_{c}") for i, c in enumerate("abcd")]
    return d.select(
        "doc_id", F.concat(F.lit("q"), "doc_id").alias("question_id"), "source", "language", F.concat(F.lit("task"), F.col("doc_id") % 5).alias("task"), F.col("t").alias("story"),
        F.concat(F.lit("Which word comes "), F.col("doc_id") % 3, F.lit("?")).alias("question"), *opts, F.char(F.col("doc_id") % 4 + 65).alias("gold"),
    )


#: Evaluation results of three models under three protocols.
RESULTS_SQL = """(SELECT *, coalesce(pred = gold, FALSE) AS correct FROM (SELECT doc_id, 'q' || doc_id AS question_id, lang AS language, source AS task, 'm' || m AS model, ['direct', 'cot', 'vote'][p + 1] AS protocol, p,
 chr(CAST(65 + doc_id % 4 AS INT)) AS gold,
 CASE WHEN (doc_id + m) % 97 = 0 THEN NULL WHEN (doc_id * 31 + m * 17 + p * 7) % 10 < 5 + m THEN chr(CAST(65 + doc_id % 4 AS INT)) ELSE chr(CAST(65 + (doc_id + m + p) % 4 AS INT)) END AS pred,
 (doc_id + 3 * m + p) % 41 = 0 AS truncated, n_chars % 4096 + p AS out_len
 FROM documents, (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest([0, 1, 2]) AS p)))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    d = d.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1)))).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(len(PROTOCOLS) - 1))))
    gold = F.char(F.col("doc_id") % 4 + 65)
    pred = F.expr("CASE WHEN (doc_id + m) % 97 = 0 THEN NULL WHEN (doc_id * 31 + m * 17 + p * 7) % 10 < 5 + m THEN char(65 + doc_id % 4) ELSE char(65 + (doc_id + m + p) % 4) END")
    return d.select(
        "doc_id", F.concat(F.lit("q"), "doc_id").alias("question_id"), F.col("lang").alias("language"), F.col("source").alias("task"), F.concat(F.lit("m"), "m").alias("model"),
        F.get(F.array(*map(F.lit, PROTOCOLS)), F.col("p")).alias("protocol"), "p", gold.alias("gold"), pred.alias("pred"), F.expr("(doc_id + 3 * m + p) % 41 = 0").alias("truncated"), (F.col("n_chars") % 4096 + F.col("p")).alias("out_len"),
    ).withColumn("correct", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)))


#: Model responses: boxed twice, a bare letter, a word with capitals, null, or plain text.
RESPONSES_SQL = r"""(SELECT doc_id, n_chars, source, lang, chr(CAST(65 + doc_id % 4 AS INT)) AS gold, CASE doc_id % 5 WHEN 0 THEN 'Some reasoning. \boxed{' || chr(CAST(65 + doc_id % 4 AS INT)) || '} then \boxed{' || chr(CAST(65 + (doc_id + 1) % 4 AS INT)) || '}'
 WHEN 1 THEN 'The answer is ' || chr(CAST(65 + doc_id % 4 AS INT)) WHEN 2 THEN 'Because nothing fits' WHEN 3 THEN NULL ELSE text END AS response FROM documents)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.char(F.col("doc_id") % 4 + 65), F.char((F.col("doc_id") + 1) % 4 + 65)
    k = F.col("doc_id") % 5
    r = F.when(k == 0, F.concat(F.lit("Some reasoning. \\boxed{"), a, F.lit("} then \\boxed{"), b, F.lit("}"))).when(k == 1, F.concat(F.lit("The answer is "), a)).when(k == 2, "Because nothing fits").when(k == 3, F.lit(None)).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", "n_chars", "source", "lang", a.alias("gold"), r.alias("response"))


#: A training log: one series per run and tag, numbered by time.
METRICS_SQL = "(SELECT CAST(user_id % 5 AS VARCHAR) AS run, event_type AS tag, row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) AS step, value FROM events)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("run", "tag").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("run"), F.col("event_type").alias("tag"), "ts", "event_id", "value")
    return e.select("run", "tag", F.row_number().over(w).cast("long").alias("step"), "value")


def options(row: DataFrame) -> DataFrame:
    """A question table with its four options as an array."""
    return row.withColumn("options", F.array("opt_a", "opt_b", "opt_c", "opt_d"))
