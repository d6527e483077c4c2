"""Queries of sources, sinks and streams; files that they need are written to the session's shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from marlstone.operators.lineage import cut  # noqa: F401  (sets the checkpoint folder where it is unset)
from marlstone.plans.fixtures import METRICS_SQL, documents, metrics, table
from marlstone.plans.registry import query
from marlstone.sources import event_files, readers, sinks
from marlstone.streaming import monitors


def _place(spark) -> str:
    """A new folder that the driver and all executors see."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        cut(spark.range(1))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


_DOC = "doc_id bigint, lang string, n_chars bigint"


@query("s_src_01_jsonl", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, d):
    sinks.jsonl(documents(spark, d).select("doc_id", "lang", "n_chars"), path := _place(spark))
    return readers.jsonl(spark, path, _DOC)


@query("s_src_02_jsonl_blank_lines", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    documents(spark, d).select(F.concat(F.to_json(F.struct("doc_id", "lang")), F.lit("\n\n"))).write.text(path := _place(spark))
    return readers.jsonl(spark, path, "doc_id bigint, lang string")


@query("s_src_03_jsonl_lenient", "SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def _(spark, d):
    line = F.when(F.col("doc_id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct("doc_id", "lang")))
    documents(spark, d).select(line).write.text(path := _place(spark))
    return readers.jsonl_lenient(spark, path, "doc_id bigint, lang string")


@query("s_src_04_missing_file", "SELECT doc_id, lang, n_chars FROM documents WHERE FALSE")
def _(spark, d):
    return readers.or_empty(spark, _place(spark), _DOC)


@query("s_src_05_json_array", "SELECT doc_id, lang, text FROM documents")
def _(spark, d):
    sinks.json_arrays(documents(spark, d).select("doc_id", "lang", "text"), path := _place(spark))
    return readers.json_array(spark, path, "doc_id bigint, lang string, text string")


@query("s_src_06_polymorphic_results", "SELECT doc_id, p AS protocol FROM documents, (SELECT unnest([NULL, 'a', 'b']) AS p)")
def _(spark, d):
    """The three forms of result files; the nested ones hold what one partition of the written arrays holds."""
    rows, out = documents(spark, d).select("doc_id"), None
    for before, after in (("", ""), ('{"a": {"n": 1, "records": ', "}}"), ('{"other": [], "results": {"b": ', "}}")):
        sinks.json_arrays(rows, path := _place(spark))
        if before:  # around the array of each file, line by line
            lines = spark.read.text(path).withColumn("file", F.input_file_name())
            kept = F.when(F.col("value") == "[", before + "[").when(F.col("value") == "]", "]" + after).otherwise(F.col("value"))
            lines.select(kept).write.text(path := _place(spark))
        one = readers.results(spark, path, "doc_id bigint")
        out = one if out is None else out.unionByName(one)
    return out


@query("s_src_07_csv", "SELECT doc_id, lang, text FROM documents")
def _(spark, d):
    documents(spark, d).select("doc_id", "lang", "text").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path := _place(spark))
    return readers.csv(spark, path, "doc_id bigint, lang string, text string")


@query("s_src_08_parquet", "SELECT doc_id, source FROM documents WHERE n_chars > 1000")
def _(spark, d):
    return readers.parquet(spark, f"{d}/documents.parquet").where("n_chars > 1000").select("doc_id", "source")


@query("s_src_09_hub_export", "SELECT doc_id FROM documents WHERE lang = 'de'")
def _(spark, d):
    documents(spark, d).where("lang = 'de'").select("doc_id").write.parquet(f"{(root := _place(spark))}/org__set/default/test")
    return readers.hub_export(spark, root, "org/set", split="test")


@query("s_src_11_staged_file", "SELECT DISTINCT source AS value, 1 AS fetched FROM documents")
def _(spark, d):
    """A list of the corpus' sources is asked for twice, and fetched once."""
    calls, folder = [], _place(spark)
    body = "".join(f"{r[0]}\n" for r in documents(spark, d).select("source").distinct().collect()).encode()
    fetch = lambda url: calls.append(url) or body
    for _ in range(2):
        path = readers.staged(spark, "http://host/a.txt", folder, fetch)
    return spark.read.text(path).withColumn("fetched", F.lit(len(calls)))


@query("s_src_10_fallback_chain", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def _(spark, d):
    docs = documents(spark, d).select("doc_id", "lang")
    out = readers.first_of(lambda: spark.read.parquet(_place(spark)), lambda: docs.where("lang = 'none'"), lambda: docs.where("lang = 'fr'"))
    return out.select("doc_id")


@query("s_src_12_positional_zip", "SELECT row_number() OVER (ORDER BY item_id) - 1 AS line, item_id, 'L' || item_id AS label FROM benchmark")
def _(spark, d):
    rows = table(spark, d, "benchmark").orderBy("item_id").coalesce(1)
    rows.select(F.to_json(F.struct("item_id"))).write.text(a := _place(spark))
    rows.select(F.concat(F.lit("L"), "item_id")).write.text(b := _place(spark))
    return readers.zipped(spark, a, b, "item_id bigint")


_LOG = "SELECT event_id AS step, event_type AS tag, value FROM events WHERE event_id % 5 <> 0"


@query("s_src_13_log_series", _LOG)
def _(spark, d):
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, "no payload here").otherwise(F.concat(F.lit("INFO 12:00 "), F.to_json(F.struct(F.col("event_id").alias("step"), F.create_map("event_type", "value").alias("metrics"))), F.lit(" done")))
    e.select(line).write.text(path := _place(spark))
    return readers.log_series(spark.read.text(path))


@query("s_src_14_log_matches", "SELECT event_id FROM events")
def _(spark, d):
    table(spark, d, "events").select(F.concat(F.lit("step: "), "event_id", F.lit(" |"))).write.text(path := _place(spark))
    return readers.log_matches(spark, path, r"step: (.*?) \|").select(F.col("match").cast("bigint").alias("event_id"))


@query("s_src_15_newest_file", "SELECT r_name AS value FROM region")
def _(spark, d):
    """Lines of the newer of two files; the other one's time is set back."""
    root = _place(spark)
    for name, table_name, column in (("old", "nation", "n_name"), ("new", "region", "r_name")):
        table(spark, d, table_name).select(column).coalesce(1).write.text(f"{root}/{name}")
    old = spark._jvm.org.apache.hadoop.fs.Path(readers.newest(spark, f"{root}/old/part-*").first().path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(old, 1_000_000, -1)
    return spark.read.text(readers.newest(spark, f"{root}/*/part-*").first().path)


@query("s_src_16_scalars", f"SELECT run, step, value FROM {METRICS_SQL} WHERE tag = 'click'")
def _(spark, d):
    """The log is written as event files, one for each run and task, and one tag is read back."""
    event_files.write_events(metrics(spark, d), path := _place(spark))
    return event_files.read_events(spark, path, "click").select("run", "step", "value")


@query("s_src_17_config_difference", "SELECT DISTINCT lang || '.' || source AS name FROM documents WHERE source <> 'src1' EXCEPT SELECT lang || '.' || source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    """A configuration for the labelled documents' languages and sources is declared, one for all documents' is used."""
    from marlstone.operators.joins import key_difference

    def config(docs) -> str:
        by = docs.groupBy("lang").agg(F.collect_set("source").alias("s")).orderBy("lang").collect()
        return "".join(f"{r.lang}:  # language\n" + "".join(f"  {x}: 1\n" for x in r.s) for r in by)

    docs = documents(spark, d)
    declared = readers.config_names(spark, config(docs.join(table(spark, d, "labels"), "doc_id", "left_semi")))
    used = readers.config_names(spark, config(docs))
    return key_difference(declared, used, tuple(f"{r.lang}.src1" for r in docs.select("lang").distinct().collect()))


@query("s_snk_01_jsonl", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    rows = documents(spark, d).select("doc_id", "lang")
    sinks.jsonl(rows.limit(1), path := _place(spark))
    sinks.jsonl(rows, path)
    return readers.jsonl(spark, path, "doc_id bigint, lang string")


@query("s_snk_02_jsonl_append", "SELECT doc_id FROM documents")
def _(spark, d):
    path, rows = _place(spark), documents(spark, d).select("doc_id")
    for odd in (0, 1):
        sinks.jsonl(rows.where(F.col("doc_id") % 2 == odd), path, append=True)
    return readers.jsonl(spark, path, "doc_id bigint")


@query("s_snk_03_json_report", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    import json

    text = sinks.json_report(documents(spark, d).groupBy("lang").agg(F.count("*").alias("n")))
    return spark.createDataFrame([(r["lang"], r["n"]) for r in json.loads(text)], "lang string, n bigint")


@query("s_snk_04_versions", "SELECT doc_id, v AS version FROM documents, (SELECT unnest([1, 2]) AS v) WHERE v = 1 OR lang = 'en'")
def _(spark, d):
    path, rows = _place(spark), documents(spark, d).select("doc_id", "lang")
    sinks.versioned(rows.select("doc_id"), path, "1")
    sinks.versioned(rows.where("lang = 'en'").select("doc_id"), path, "2")
    return spark.read.parquet(path)


def _lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "i bigint, line string")


@query("s_snk_05_markdown_report", """SELECT row_number() OVER (ORDER BY o, lang NULLS FIRST) AS i, line FROM (SELECT 0 AS o, NULL AS lang, '| lang | mean |' AS line UNION ALL SELECT 1, NULL, '|---|---|'
 UNION ALL SELECT 2, lang, '| ' || coalesce(lang, '—') || ' | ' || printf('%.4f', avg(n_chars)) || ' |' FROM documents GROUP BY lang)""")
def _(spark, d):
    return _lines(spark, sinks.markdown(documents(spark, d).groupBy("lang").agg(F.avg("n_chars").alias("mean")).orderBy("lang")))


@query("s_snk_06_audit_report", "SELECT (SELECT count(*) FROM documents) AS total, coalesce(lang, '?') AS lang, count(*) AS n FROM documents GROUP BY 2")
def _(spark, d):
    return sinks.audit(documents(spark, d), "lang").select("total", F.explode("dist").alias("lang", "n"))


@query("s_snk_07_data_card", """WITH n AS (SELECT coalesce(lang, '?') AS v, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM n),
l AS (SELECT 0 AS o, '' AS v, unnest(['# Corpus', '', 'Rows: ' || n, '', '## lang', '', '| value | n | share |', '|---|---|---|']) AS line, unnest(range(0, 8)) AS k FROM t
 UNION ALL SELECT 1, n.v, '| ' || n.v || ' | ' || n.n || ' | ' || printf('%.4f', n.n / t.n) || ' |', -n.n FROM n, t)
SELECT row_number() OVER (ORDER BY o, k, v) AS i, line FROM l""")
def _(spark, d):
    return _lines(spark, sinks.data_card(documents(spark, d), "Corpus", ("lang",)))


@query("s_snk_08_tidy_series", f"SELECT tag, run, step, value FROM {METRICS_SQL} ORDER BY tag, run, step")
def _(spark, d):
    return sinks.tidy_series(metrics(spark, d))


@query("s_snk_09_best_pointer", f"SELECT run, tag, step, value FROM {METRICS_SQL} QUALIFY row_number() OVER (PARTITION BY run, tag ORDER BY value DESC, step) = 1")
def _(spark, d):
    sinks.best_pointer(metrics(spark, d), path := _place(spark))
    return spark.read.parquet(path)


@query("s_snk_10_manifest", """WITH f AS (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS t FROM nation)
SELECT strlen(t) AS length, sha256(t) AS sha256, state FROM f, (SELECT unnest(['missing', 'changed', 'extra', 'same']) AS state)""")
def _(spark, d):
    """A file's size and digest, and what is said of it when the expected manifest has another name, another digest,
    nothing, or the same."""
    table(spark, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path := _place(spark))
    found = sinks.manifest(spark, f"{path}/part-*")
    same = found.select("name", "sha256")
    wants = {"missing": same.union(spark.createDataFrame([("gone", "0")], "name string, sha256 string")), "changed": same.withColumn("sha256", F.lit("0")), "extra": same.limit(0)}
    states = [sinks.verify(found, w).select("state") for w in wants.values()]
    states.append(spark.createDataFrame([("same",)], "state string").where(sinks.verify(found, same).agg(F.count("*") == 0).scalar()))
    out = states[0].union(states[1]).union(states[2]).union(states[3])
    return out.select(found.select("length").scalar().alias("length"), found.select("sha256").scalar().alias("sha256"), "state")


def _stream(spark, d):
    metrics(spark, d).write.parquet(path := _place(spark))
    return spark.readStream.schema("run string, tag string, step bigint, value double").parquet(path)


@query("s_str_01_stop_rules", f"SELECT run, 'kl' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY step DESC) AS r FROM {METRICS_SQL} WHERE tag = 'click') WHERE r <= 3 GROUP BY run HAVING count(*) = 3 AND min(value) > 0.5")
def _(spark, d):
    got: list = []
    q = monitors.watch(_stream(spark, d).withColumn("tag", F.when(F.col("tag") == "click", "kl").otherwise(F.col("tag"))), got.extend, _place(spark))
    q.awaitTermination()
    return spark.createDataFrame(got, "run string, reason string")


@query("s_str_02_running_best", f"SELECT run, tag, step, value FROM {METRICS_SQL} QUALIFY row_number() OVER (PARTITION BY run, tag ORDER BY value DESC, step) = 1")
def _(spark, d):
    return monitors.drained(spark, monitors.running_best(_stream(spark, d)), f"best_{uuid.uuid4().hex}")


@query("s_str_03_progress_counters", "SELECT count(*) AS n, count(*) FILTER (value IS NULL) AS nulls FROM events")
def _(spark, d):
    """The counters that came in while the rows were written."""
    seen = Observation()
    monitors.progress(table(spark, d, "events").select("event_id", "value"), seen).write.parquet(_place(spark))
    return spark.createDataFrame([(seen.get["rows"], seen.get["nulls"])], "n bigint, nulls bigint")


@query("s_str_04_streamed_answers", "SELECT doc_id, source || lang AS content, 7 AS completion_tokens FROM documents")
def _(spark, d):
    from marlstone.operators.model_calls import stream_text

    piece = lambda c: F.concat(F.lit('data: {"choices": [{"delta": {"content": "'), c, F.lit('"}}]}'))
    lines = F.array(piece(F.col("source")), F.lit(""), piece(F.col("lang")), F.lit('data: {"choices": [], "usage": {"prompt_tokens": 3, "completion_tokens": 7}}'), F.lit("data: [DONE]"))
    return stream_text(documents(spark, d).select("doc_id", F.posexplode(lines).alias("i", "line")), ["doc_id"], "i")


@query("s_str_05_resume_by_key", "SELECT DISTINCT user_id FROM events")
def _(spark, d):
    """Every key once, however late it comes again."""
    table(spark, d, "events").select("user_id", "ts").write.parquet(path := _place(spark))
    s = spark.readStream.schema("user_id bigint, ts timestamp").parquet(path)
    return monitors.drained(spark, monitors.append_new(s, ["user_id"]), f"keys_{uuid.uuid4().hex}", "append").select("user_id")


@query("event_type_totals", "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type")
def _(spark, d):
    table(spark, d, "events").select("event_type", "value").write.parquet(path := _place(spark))
    s = spark.readStream.schema("event_type string, value double").parquet(path)
    return monitors.drained(spark, s.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top")), f"types_{uuid.uuid4().hex}")
