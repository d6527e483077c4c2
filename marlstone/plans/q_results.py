"""Queries of joins, set operations and aggregates over evaluation results."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import aggregates as agg, filters, joins, sampling
from marlstone.plans.fixtures import METRICS_SQL, RESPONSES_SQL, RESULTS_SQL, documents, metrics, responses, results, table
from marlstone.plans.registry import query

_S = RESULTS_SQL


def _cell(m: str, p: str = "direct") -> str:
    return f"(SELECT * FROM {_S} WHERE model = '{m}' AND protocol = '{p}')"


def _rows(spark, d, m, p="direct"):
    return results(spark, d).where((F.col("model") == m) & (F.col("protocol") == p))


_PART = f"(SELECT * FROM {_cell('m1')} WHERE doc_id % 3 <> 0)"


def _part(spark, d):
    return _rows(spark, d, "m1").where("doc_id % 3 <> 0")


@query("s_join_01_paired_inner", f"SELECT a.question_id, a.correct, b.correct AS ref_correct FROM {_cell('m0')} a JOIN {_PART} b USING (question_id)")
def _(spark, d):
    return joins.paired(_rows(spark, d, "m0"), _part(spark, d), ["question_id"]).select("question_id", "correct", "ref_correct")


@query("s_join_02_paired_missing_wrong", f"SELECT a.question_id, coalesce(b.correct, FALSE) AS ref_correct FROM {_cell('m0')} a LEFT JOIN {_PART} b USING (question_id)")
def _(spark, d):
    return joins.paired(_rows(spark, d, "m0"), _part(spark, d), ["question_id"], "wrong").select("question_id", "ref_correct")


@query("s_join_03_paired_missing_null", f"SELECT a.question_id, b.correct AS ref_correct, NOT coalesce(b.correct, FALSE) AS ref_wrong FROM {_cell('m0')} a LEFT JOIN {_PART} b USING (question_id)")
def _(spark, d):
    return joins.paired(_rows(spark, d, "m0"), _part(spark, d), ["question_id"], "null").select("question_id", "ref_correct", "ref_wrong")


@query("s_join_04_joined_all", f"SELECT a.question_id, a.task, a.correct AS m0, b.correct AS m1, c.correct AS m2 FROM {_cell('m0')} a JOIN {_cell('m1')} b USING (question_id) JOIN {_cell('m2')} c USING (question_id)")
def _(spark, d):
    meta = _rows(spark, d, "m0").select("question_id", "task")
    return joins.joined_all(meta, {m: _rows(spark, d, m) for m in ("m0", "m1", "m2")})


@query("s_join_05_ordinal_join", "SELECT d.doc_id, l.doc_id AS label_id, quality FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents) d JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) AS place FROM labels) l USING (place)")
def _(spark, d):
    """Rows meet by their positions in two tables, whatever their ids."""
    rows, _n = sampling.numbered(documents(spark, d).select("doc_id"), [F.col("doc_id")])
    labels, _n = sampling.numbered(table(spark, d, "labels").select(F.col("doc_id").alias("label_id"), "quality"), [F.col("label_id")])
    return rows.join(labels, "at").select("doc_id", "label_id", "quality")


@query(
    "s_join_06_contingency",
    f"SELECT a.task, count(*) FILTER (a.correct AND b.correct) AS both_right, count(*) FILTER (NOT a.correct AND b.correct) AS only_ref, count(*) FILTER (a.correct AND NOT b.correct) AS only_ours, count(*) FILTER (NOT a.correct AND NOT b.correct) AS both_wrong, count(*) AS n FROM {_cell('m0')} a JOIN {_cell('m1')} b USING (question_id) GROUP BY GROUPING SETS ((a.task), ())",
)
def _(spark, d):
    return joins.contingency(joins.paired(_rows(spark, d, "m0"), _rows(spark, d, "m1"), ["question_id"]), ["task"])


_THREE = f"(SELECT m.question_id, m.task, CASE WHEN coalesce(a.correct, FALSE) AND coalesce(b.correct, FALSE) THEN 'both_right' WHEN coalesce(a.correct, FALSE) THEN 'only_a' WHEN coalesce(b.correct, FALSE) THEN 'only_b' ELSE 'all_wrong' END AS kind FROM {_cell('m0')} m LEFT JOIN {_PART} a USING (question_id) LEFT JOIN {_cell('m2')} b USING (question_id) WHERE NOT m.correct)"


@query("s_join_07_error_classes", f"SELECT task, kind, count(*) AS n FROM {_THREE} GROUP BY task, kind")
def _(spark, d):
    return joins.error_classes(_rows(spark, d, "m0"), _part(spark, d), _rows(spark, d, "m2")).groupBy("task", "kind").agg(F.count("*").alias("n"))


@query("s_join_07_hot_questions", f"SELECT question_id FROM {_THREE} WHERE kind = 'both_right'")
def _(spark, d):
    return joins.error_classes(_rows(spark, d, "m0"), _part(spark, d), _rows(spark, d, "m2")).where("kind = 'both_right'").select("question_id")


@query("s_join_08_changes", f"SELECT a.task, count(*) FILTER (a.correct AND NOT b.correct) AS regressions, count(*) FILTER (NOT a.correct AND b.correct) AS improvements, count(*) FILTER (NOT a.correct AND b.correct) - count(*) FILTER (a.correct AND NOT b.correct) AS net FROM {_cell('m0')} a JOIN {_cell('m2')} b USING (question_id) GROUP BY a.task")
def _(spark, d):
    return joins.changes(_rows(spark, d, "m0"), _rows(spark, d, "m2"), "question_id", "task")


@query("s_join_09_closeable_gap", f"SELECT sum(greatest(gap, 0) * n) / sum(n) AS upside FROM (SELECT a.task, count(*) AS n, avg(b.correct::INT) - avg(a.correct::INT) AS gap FROM {_cell('m0')} a JOIN {_cell('m1')} b USING (question_id) GROUP BY a.task)")
def _(spark, d):
    return joins.closeable_gap(joins.paired(_rows(spark, d, "m0"), _rows(spark, d, "m1"), ["question_id"]), "task")


@query("s_join_10_restrict", f"SELECT question_id, model, protocol FROM {_S} WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return joins.restrict(results(spark, d), table(spark, d, "labels"), "doc_id").select("question_id", "model", "protocol")


@query("s_join_11_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return joins.resume(documents(spark, d), table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("s_join_12_any_error", f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM {_S} WHERE model = 'm2' AND NOT correct)")
def _(spark, d):
    return joins.error_rows(documents(spark, d), results(spark, d).where("model = 'm2'"), "doc_id").select("doc_id")


@query("s_join_13_repeated_error", f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM {_S} WHERE model = 'm0' AND NOT correct GROUP BY doc_id HAVING count(*) >= 2)")
def _(spark, d):
    return joins.error_rows(documents(spark, d), results(spark, d).where("model = 'm0'"), "doc_id", 2).select("doc_id")


@query("s_join_14_fan_out", "SELECT doc_id, v AS variant FROM documents, (SELECT unnest([0, 1, 2]) AS v)")
def _(spark, d):
    return joins.fan_out(documents(spark, d).select("doc_id"), "variant", [0, 1, 2])


@query("s_join_15_cell_fallback", f"SELECT model, task, provenance, count(*) AS n FROM (SELECT model, task, 'new' AS provenance FROM {_S} WHERE protocol = 'cot' AND model <> 'm1' UNION ALL SELECT model, task, 'fallback' FROM {_S} WHERE protocol = 'direct' AND model = 'm1') GROUP BY ALL")
def _(spark, d):
    r = results(spark, d)
    out = joins.fallback(r.where("protocol = 'cot' AND model <> 'm1'"), r.where("protocol = 'direct'"), ["model", "task"])
    return out.groupBy("model", "task", "provenance").agg(F.count("*").alias("n"))


@query("s_join_16_agreement", f"SELECT count(*) AS n, avg((a.pred IS NOT DISTINCT FROM b.pred)::INT) AS agreement FROM {_cell('m0')} a JOIN {_cell('m2')} b USING (question_id)")
def _(spark, d):
    return joins.agreement(_rows(spark, d, "m0"), _rows(spark, d, "m2"), ["question_id"])


@query("s_set_01_union_ordered", "SELECT doc_id, 0 AS source_ord FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'fr'")
def _(spark, d):
    r = documents(spark, d).select("doc_id", "lang")
    return joins.union_ordered([r.where("lang = 'en'"), r.where("lang = 'fr'")]).select("doc_id", "source_ord")


@query("s_set_02_append", "SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en'")
def _(spark, d):
    r = documents(spark, d).select("doc_id", "lang")
    return r.where("lang = 'en'").unionByName(r.where("NOT lang <=> 'en'")).select("doc_id")


@query("s_set_03_update", f"SELECT task, coalesce(b.v, a.v) AS v FROM (SELECT task, avg(correct::INT) AS v FROM {_S} WHERE model = 'm0' GROUP BY task) a FULL JOIN (SELECT task, avg(correct::INT) AS v FROM {_S} WHERE model = 'm1' AND task < 'src5' GROUP BY task) b USING (task)")
def _(spark, d):
    v = lambda r: r.groupBy("task").agg(F.avg(F.col("correct").cast("int")).alias("v"))
    r = results(spark, d)
    return joins.update(v(r.where("model = 'm0'")), v(r.where("model = 'm1' AND task < 'src5'")), ["task"], "v")


@query("s_set_04_key_difference", "SELECT DISTINCT source AS name FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 3000) AND source <> 'src1'")
def _(spark, d):
    r = documents(spark, d).select(F.col("source").alias("name"), "lang", "n_chars")
    return joins.key_difference(r.where("lang = 'es' AND n_chars > 3000"), r, ("src1",))


@query(
    "s_agg_01_accuracy_cube",
    f"""SELECT model, protocol, count(*) AS n, avg(correct::INT) AS overall, coalesce(avg(correct::INT) FILTER (language = 'en'), 0) AS en, coalesce(avg(correct::INT) FILTER (language = 'zh'), 0) AS zh, avg(correct::INT) FILTER (task = 'src3') AS src3 FROM {_S} GROUP BY model, protocol""",
)
def _(spark, d):
    c = agg.accuracy_cube(results(spark, d))
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0.0)).alias(k)
    return c.select("model", "protocol", "n", "overall", at("by_language", "en"), at("by_language", "zh"), at("by_task", "src3"))


@query("s_agg_02_frequency", f"SELECT coalesce(pred, '?') AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {_S} GROUP BY 1")
def _(spark, d):
    return agg.frequency(results(spark, d), "pred")


@query("s_agg_03_share_by_source", f"WITH c AS (SELECT task, gold, count(*) AS n, grouping(task) = 1 AS overall FROM {_S} GROUP BY GROUPING SETS ((task, gold), (gold))) SELECT task, gold, n, n / sum(n) OVER (PARTITION BY task, overall) AS share, overall FROM c")
def _(spark, d):
    return agg.share_by(results(spark, d), "task", "gold")


_CELL = "CASE WHEN count(*) FILTER (model = '{m}') = 0 THEN '—' ELSE printf('%.4f (%d/%d)', count(*) FILTER (model = '{m}' AND correct) / count(*) FILTER (model = '{m}'), count(*) FILTER (model = '{m}' AND correct), count(*) FILTER (model = '{m}')) END AS {m}"


@query("s_agg_04_accuracy_cells", f"SELECT protocol, task, {', '.join(_CELL.format(m=m) for m in ('m0', 'm1', 'm9'))} FROM {_S} GROUP BY protocol, task")
def _(spark, d):
    return agg.cell(results(spark, d), ["protocol", "task"], "model", ["m0", "m1", "m9"])


@query("s_agg_05_main_table", f"SELECT model, task, {', '.join(f'avg(correct::INT) FILTER (protocol = {p!r}) AS {p}' for p in ('direct', 'cot', 'vote'))} FROM {_S} GROUP BY model, task")
def _(spark, d):
    return agg.pivot_accuracy(results(spark, d), ["model", "task"], "protocol", ["direct", "cot", "vote"])


_BEST = f"(SELECT model, benchmark, protocol, acc FROM (SELECT model, language AS benchmark, protocol, avg(correct::INT) AS acc FROM {_S} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model, benchmark ORDER BY acc DESC, list_position(['direct', 'cot', 'vote'], protocol)) = 1)"


def _best(spark, d):
    return agg.best_protocol(results(spark, d).withColumnRenamed("language", "benchmark"), ["direct", "cot", "vote"])


@query("s_agg_06_best_protocol", f"SELECT * FROM {_BEST}")
def _(spark, d):
    return _best(spark, d)


@query("s_agg_06_best_mean", f"SELECT model, count(*) AS n, avg(acc) AS mean FROM {_BEST} GROUP BY model")
def _(spark, d):
    return agg.best_mean(_best(spark, d))


_PARTIAL = f"(SELECT * FROM {_BEST} WHERE NOT (model = 'm1' AND benchmark = 'es'))"


def _partial(spark, d):
    return _best(spark, d).where("NOT (model = 'm1' AND benchmark = 'es')")


@query("s_agg_07_complete_mean", f"SELECT model, count(*) AS n, CASE WHEN count(*) = 4 THEN avg(acc) END AS mean FROM {_PARTIAL} GROUP BY model")
def _(spark, d):
    return agg.best_mean(_partial(spark, d), complete=4)


@query("s_agg_08_winner", f"SELECT model, mean FROM (SELECT model, CASE WHEN count(*) = 4 THEN avg(acc) END AS mean FROM {_PARTIAL} GROUP BY model) WHERE model <> 'm2' AND mean IS NOT NULL ORDER BY mean DESC, model LIMIT 1")
def _(spark, d):
    return agg.winner(agg.best_mean(_partial(spark, d), complete=4), "m2")


@query("s_agg_09_sweep_verdict", f"SELECT model, CASE WHEN mean > 0.7 AND low >= 0.6 THEN 'adopt' WHEN mean > 0.7 THEN 'better mean, floor broken' WHEN low >= 0.6 THEN 'floor holds, no gain' ELSE 'reject' END AS verdict FROM (SELECT model, avg(acc) AS mean, min(acc) AS low FROM {_BEST} GROUP BY model)")
def _(spark, d):
    m = _best(spark, d).groupBy("model").agg(F.avg("acc").alias("mean"), F.min("acc").alias("low"))
    return m.select("model", agg.judge_sweep(F.col("mean"), F.lit(0.7), F.col("low"), 0.6).alias("verdict"))


_ACC = "SELECT task, avg(correct::INT) AS acc FROM {} GROUP BY task"


@query("s_agg_10_delta", f"SELECT a.task, a.acc, (a.acc - b.acc) * 100 AS delta_pp FROM ({_ACC.format(_cell('m1'))}) a LEFT JOIN ({_ACC.format(_cell('m0'))} HAVING task <> 'src1') b USING (task)")
def _(spark, d):
    acc = lambda r: r.groupBy("task").agg(F.avg(F.col("correct").cast("int")).alias("acc"))
    return agg.delta(acc(_rows(spark, d, "m1")), acc(_rows(spark, d, "m0").where("task <> 'src1'")), ["task"], "acc")


@query("s_agg_11_near_reference", f"WITH m AS (SELECT model, avg(acc) AS mean FROM {_BEST} GROUP BY model) SELECT model, mean, r - mean AS distance, r - mean <= 0.2 AS near FROM m, (SELECT mean AS r FROM m WHERE model = 'm2')")
def _(spark, d):
    return agg.near_reference(agg.best_mean(_best(spark, d)), "m2", 0.2)


@query("s_agg_12_truncation", f"SELECT model, protocol, count(*) FILTER (truncated) AS n, avg(truncated::INT) AS rate, avg(truncated::INT) >= 0.01 AS flag FROM {_S} GROUP BY model, protocol")
def _(spark, d):
    rate = F.avg(F.col("truncated").cast("int"))
    return results(spark, d).groupBy("model", "protocol").agg(F.count_if("truncated").alias("n"), rate.alias("rate"), (rate >= 0.01).alias("flag"))


@query("s_agg_13_output_length", f"SELECT model, avg(out_len) AS mean, max(out_len) AS max, list_sort(list(out_len))[1 + CAST(floor(95 * (count(*) - 1) / 100) AS BIGINT)] AS p95 FROM {_S} GROUP BY model")
def _(spark, d):
    r = results(spark, d)
    return r.groupBy("model").agg(F.avg("out_len").alias("mean"), F.max("out_len").alias("max")).join(agg.nearest_rank(r, ["model"], "out_len", [95], "n-1"), "model")


@query("s_agg_14_unparseable", f"SELECT model, protocol, count(*) FILTER (pred IS NULL) AS n FROM {_S} GROUP BY model, protocol")
def _(spark, d):
    return results(spark, d).groupBy("model", "protocol").agg(F.count_if(F.col("pred").isNull()).alias("n"))


_CONF = ", ".join(f"count(*) FILTER (pred = '{x}') AS \"{x}\"" for x in "ABCD")


@query("s_agg_15_confusion", f"SELECT gold, {_CONF} FROM {_S} WHERE NOT correct GROUP BY gold")
def _(spark, d):
    return agg.confusion(results(spark, d)).drop("invalid")


@query("s_agg_16_confusion_invalid", f"SELECT gold, {_CONF}, count(*) FILTER (pred IS NULL) AS invalid FROM {_S} GROUP BY gold")
def _(spark, d):
    return agg.confusion(results(spark, d), errors_only=False)


@query("s_agg_17_letter_distribution", f"SELECT model, coalesce(pred, 'invalid') AS letter, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY model) AS share FROM {_S} GROUP BY 1, 2")
def _(spark, d):
    rows = results(spark, d).withColumn("letter", F.coalesce("pred", F.lit("invalid")))
    return agg.share_by(rows, "model", "letter").where("NOT overall").drop("overall")


@query("s_agg_18_language_gap", f"SELECT a.language, avg(a.correct::INT) AS ours, avg(b.correct::INT) AS ref, (avg(b.correct::INT) - avg(a.correct::INT)) * 100 AS gap_pp FROM {_cell('m0')} a JOIN {_cell('m1')} b USING (question_id) GROUP BY a.language")
def _(spark, d):
    p = joins.paired(_rows(spark, d, "m0"), _rows(spark, d, "m1"), ["question_id"])
    a, b = F.avg(F.col("correct").cast("int")), F.avg(F.col("ref_correct").cast("int"))
    return p.groupBy("language").agg(a.alias("ours"), b.alias("ref"), ((b - a) * 100).alias("gap_pp"))


@query("s_agg_19_task_language", f"SELECT task, language, avg(correct::INT) FILTER (model = 'm0') AS m0, avg(correct::INT) FILTER (model = 'm1') AS m1, avg(correct::INT) FILTER (model = 'm1') - avg(correct::INT) FILTER (model = 'm0') AS diff FROM {_S} GROUP BY task, language")
def _(spark, d):
    return agg.pivot_accuracy(results(spark, d), ["task", "language"], "model", ["m0", "m1"]).withColumn("diff", F.col("m1") - F.col("m0"))


@query("s_agg_20_response_style", rf"SELECT has_letter, avg(boxed::INT) AS boxed, avg(n) AS mean, max(n) AS max FROM (SELECT regexp_matches(response, '[A-D]') AS has_letter, contains(response, '\boxed') AS boxed, length(response) AS n FROM {RESPONSES_SQL} WHERE response IS NOT NULL) GROUP BY has_letter")
def _(spark, d):
    r = responses(spark, d).where("response IS NOT NULL")
    return r.groupBy(F.col("response").rlike("[A-D]").alias("has_letter")).agg(F.avg(F.col("response").contains("\\boxed").cast("int")).alias("boxed"), F.avg(F.length("response")).alias("mean"), F.max(F.length("response")).cast("long").alias("max"))


_RANKS = ", ".join(f"list_sort(list(n_chars))[1 + least(count(*) - 1, CAST(floor({q} * count(*) / 100) AS BIGINT))] AS p{q}" for q in (50, 75, 90, 95, 99))


@query("s_agg_21_percentiles", f"SELECT lang, {_RANKS} FROM documents GROUP BY lang")
def _(spark, d):
    return agg.nearest_rank(documents(spark, d), ["lang"], "n_chars", [50, 75, 90, 95, 99])


@query("s_agg_22_length_profile", "SELECT source, min(n_chars) AS min, max(n_chars) AS max, avg(n_chars) AS mean FROM documents GROUP BY source")
def _(spark, d):
    return documents(spark, d).groupBy("source").agg(F.min("n_chars").alias("min"), F.max("n_chars").alias("max"), F.avg("n_chars").alias("mean"))


@query("s_agg_23_histogram", "WITH b AS (SELECT unnest([0.0, 5.0, 10.0, 50.0])::DOUBLE AS low, unnest([5.0, 10.0, 50.0, 100.0])::DOUBLE AS high), c AS (SELECT low, high, count(value) AS n FROM b LEFT JOIN events ON value > low AND value <= high GROUP BY ALL) SELECT low, high, n, sum(n) OVER (ORDER BY low) / (SELECT count(value) FROM events) AS cumulative FROM c")
def _(spark, d):
    return agg.histogram(table(spark, d, "events"), "value", [0.0, 5.0, 10.0, 50.0, 100.0])


@query("s_agg_24_zero_histogram", "SELECT CASE WHEN r = 0 THEN '0' WHEN r > 0 AND r <= 0.25 THEN '(0, 0.25]' WHEN r > 0.25 AND r <= 0.5 THEN '(0.25, 0.5]' WHEN r > 0.5 AND r <= 0.94 THEN '(0.5, 0.94]' ELSE 'uncovered' END AS bin, count(*) AS n FROM (SELECT CAST(doc_id % 9 AS DOUBLE) / 8 AS r FROM documents) GROUP BY 1")
def _(spark, d):
    return agg.zero_histogram(documents(spark, d).select(((F.col("doc_id") % 9).cast("double") / 8).alias("r")), "r", [0.0, 0.25, 0.5, 0.94])


@query("s_agg_25_task_reward", f"SELECT task, avg(correct::INT) AS mean, avg((out_len < 1000)::INT) AS pass_rate FROM {_S} GROUP BY task ORDER BY mean")
def _(spark, d):
    return results(spark, d).groupBy("task").agg(F.avg(F.col("correct").cast("int")).alias("mean"), F.avg((F.col("out_len") < 1000).cast("int")).alias("pass_rate")).orderBy("mean")


@query("s_agg_26_success_rate", f"SELECT question_id, count(*) FILTER (correct) / count(*) AS rate FROM {_S} GROUP BY question_id")
def _(spark, d):
    return results(spark, d).groupBy("question_id").agg(F.avg(F.col("correct").cast("double")).alias("rate"))


@query("s_agg_27_reward_means", rf"SELECT source, avg((l IS NOT NULL)::INT) AS r_fmt, avg(coalesce(l = gold, FALSE)::INT) AS r_out FROM (SELECT *, nullif(regexp_extract(response, '\\boxed\{{([A-Z])\}}', 1), '') AS l FROM {RESPONSES_SQL}) GROUP BY source")
def _(spark, d):
    from marlstone.functions import reward

    r = reward.reward(F.col("response"), F.col("n_chars"), F.col("gold"), F.lit(256.0), reward.RewardParameters())
    return responses(spark, d).select("source", r.alias("r")).groupBy("source").agg(F.avg("r.r_fmt").alias("r_fmt"), F.avg("r.r_out").alias("r_out"))


@query("s_agg_28_outcome_rates", "SELECT count(*) FILTER (doc_id % 3 = 0) AS ok, count(*) FILTER (doc_id % 3 = 1) AS bad, count(*) FILTER (doc_id % 3 = 2) AS failed, count(*) FILTER (doc_id % 3 = 0) / count(*) FILTER (doc_id % 3 < 2) AS good_rate FROM documents")
def _(spark, d):
    o = F.get(F.array(F.lit("ok"), F.lit("bad"), F.lit("failed")), (F.col("doc_id") % 3).cast("int"))
    return agg.outcome_rates(documents(spark, d).select(o.alias("outcome")))


@query("s_agg_29_collapse_warning", "WITH c AS (SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang) SELECT (SELECT sum(n) FROM c)::BIGINT AS n, value, n / (SELECT sum(n) FROM c) AS share, n / (SELECT sum(n) FROM c) > 0.5 AS warn FROM c ORDER BY c.n DESC LIMIT 1")
def _(spark, d):
    return agg.collapse_warning(documents(spark, d), "lang")


@query("s_agg_30_judge_categories", "SELECT quality * 2 + toxic AS category, count(*) AS n FROM labels GROUP BY 1")
def _(spark, d):
    return table(spark, d, "labels").groupBy((F.col("quality") * 2 + F.col("toxic")).alias("category")).agg(F.count("*").alias("n"))


# filters


@query("s_flt_01_deny", "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'denied' WHEN n_chars < 500 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return filters.drop_report(documents(spark, d), {"denied": F.col("source").isin("src1", "src2"), "short": F.col("n_chars") < 500})


@query("s_flt_02_allow_keys", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    return filters.allow_keys(documents(spark, d), table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id")


@query("s_flt_03_prefix", "SELECT doc_id FROM documents WHERE starts_with(source, 'src1')")
def _(spark, d):
    return documents(spark, d).where(F.col("source").startswith("src1")).select("doc_id")


@query("s_flt_04_length_window", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 80 AND 1500 AND trim(lang) <> ''")
def _(spark, d):
    return filters.length_window(documents(spark, d), "text", 80, 1500, ("lang",)).select("doc_id")


@query("s_flt_05_number_in_range", "SELECT doc_id FROM documents WHERE coalesce(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE (doc_id % 10) || '.5' END AS DOUBLE), -1) BETWEEN 2 AND 7")
def _(spark, d):
    v = F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.concat(F.col("doc_id") % 10, F.lit(".5")))
    return documents(spark, d).where(filters.number_in_range(v, 2, 7)).select("doc_id")


@query("s_flt_06_sentence_gate", "SELECT doc_id FROM documents WHERE greatest(1, len(regexp_extract_all(text, '[.。！!]'))) <= 9")
def _(spark, d):
    from marlstone.functions.text import sentence_count

    return documents(spark, d).where(sentence_count(F.col("text")) <= 9).select("doc_id")


@query("s_flt_07_trace_gate", rf"SELECT doc_id FROM {RESPONSES_SQL} WHERE nullif(regexp_extract(response, '\\boxed\{{([A-D])\}}', 1), '') = gold")
def _(spark, d):
    """Three step lines and a boxed answer equal to the gold; the steps are put in front here."""
    from marlstone.functions.answers import boxed_letter
    from marlstone.functions.text import step_lines

    t = F.concat(F.lit("Step 1\n Step 2\n步骤 3\n"), "response")
    return responses(spark, d).where((step_lines(t) >= 3) & (boxed_letter(t) == F.col("gold"))).select("doc_id")


@query("s_flt_08_any_property", "SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1")
def _(spark, d):
    return table(spark, d, "labels").where((F.col("quality") == 0) | (F.col("toxic") == 1)).select("doc_id")


@query("s_flt_09_trusted_verdict", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.doc_id % 3 < 2")
def _(spark, d):
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    c = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("doc_id") % 3).cast("int"))
    return rows.where(filters.trusted(F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "wrong"), c)).select("doc_id")


@query("s_flt_10_mastery", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE (doc_id % 20) / 20.0 < 0.95")
def _(spark, d):
    lab = table(spark, d, "labels").select("doc_id", ((F.col("doc_id") % 20) / 20.0).alias("reward_mean"))
    return filters.mastery(documents(spark, d), lab, "doc_id").select("doc_id")


@query("s_flt_11_difficulty_windows", f"WITH g AS (SELECT question_id, avg(correct::INT) AS m FROM {_S} GROUP BY question_id), w AS (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS low, unnest([1.0, 0.9, 0.7])::DOUBLE AS high) SELECT low, high, count(*) FILTER (m > low AND m < high) AS n_inside, count(*) AS n FROM g, w GROUP BY low, high")
def _(spark, d):
    g = results(spark, d).groupBy("question_id").agg(F.avg(F.col("correct").cast("int")).alias("m"))
    return filters.difficulty_windows(g, "m", [(0.0, 1.0), (0.1, 0.9), (0.3, 0.7)])


@query("s_flt_12_first_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return filters.first_rows(documents(spark, d), 25, "doc_id").select("doc_id")


@query("s_flt_13_domain_routing", "SELECT CASE source WHEN 'src0' THEN 'math' WHEN 'src1' THEN 'chat' ELSE 'other' END AS domain, source NOT IN ('src0', 'src1') AS unmapped, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    domains = spark.createDataFrame([("src0", "math"), ("src1", "chat")], "tag string, domain string")
    return filters.route(documents(spark, d).withColumnRenamed("source", "tag"), domains).groupBy("domain", "unmapped").agg(F.count("*").alias("n"))


@query("s_flt_14_assertions", "SELECT 'rows' AS \"check\", count(*)::DOUBLE AS value, count(*) >= 100 AS passed FROM documents UNION ALL SELECT 'longest', max(n_chars)::DOUBLE, max(n_chars) <= 10 FROM documents")
def _(spark, d):
    return filters.assertions(documents(spark, d), {"rows": (F.count("*"), ">=", 100), "longest": (F.max("n_chars"), "<=", 10)})


# windows over a training log


_LAST = f"(SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY step DESC) AS r, max(value) OVER (PARTITION BY run, tag) AS best FROM {METRICS_SQL})"


@query("s_win_01_last_three_threshold", f"SELECT run, tag, count(*) = 3 AND min(value) > 5 AS above, count(*) = 3 AND max(value) < 50 AS below FROM {_LAST} WHERE r <= 3 GROUP BY run, tag")
def _(spark, d):
    from marlstone.operators import windows as w

    return w.last_values(metrics(spark, d), 3).select("run", "tag", w.all_above(3, 5.0).alias("above"), w.all_below(3, 50.0).alias("below"))


@query("s_win_02_last_three_below_best", f"SELECT run, tag, count(*) = 3 AND max(value) < max(best) - 0.03 AS degraded FROM {_LAST} WHERE r <= 3 GROUP BY run, tag")
def _(spark, d):
    from marlstone.operators import windows as w

    return w.below_best(metrics(spark, d), 3, 0.03)


@query("s_win_03_best_step", f"SELECT run, tag, step, value FROM {METRICS_SQL} QUALIFY row_number() OVER (PARTITION BY run, tag ORDER BY value DESC, step) = 1")
def _(spark, d):
    from marlstone.operators import windows as w

    return w.best_step(metrics(spark, d))


@query("s_win_04_best_and_final", f"SELECT run, tag, arg_max(value, step) AS final, max(value) AS best, (max(value) - arg_max(value, step)) * 100 AS delta_pp FROM {METRICS_SQL} GROUP BY run, tag")
def _(spark, d):
    from marlstone.operators import windows as w

    return w.best_and_final(metrics(spark, d))


@query("s_srt_01_sort_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def _(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("s_srt_02_sort_by_gap", f"SELECT a.task, avg(b.correct::INT) - avg(a.correct::INT) AS gap FROM {_cell('m0')} a JOIN {_cell('m1')} b USING (question_id) GROUP BY a.task ORDER BY gap DESC")
def _(spark, d):
    p = joins.paired(_rows(spark, d, "m0"), _rows(spark, d, "m1"), ["question_id"])
    return p.groupBy("task").agg((F.avg(F.col("ref_correct").cast("int")) - F.avg(F.col("correct").cast("int"))).alias("gap")).orderBy(F.desc("gap"))


@query("s_srt_03_top_examples", f"SELECT question_id, out_len FROM {_cell('m0')} ORDER BY out_len DESC, question_id LIMIT 20")
def _(spark, d):
    return _rows(spark, d, "m0").orderBy(F.desc("out_len"), "question_id").limit(20).select("question_id", "out_len")
