"""Queries of scalar functions and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import answers, jsontext, prompts, reward, text
from marlstone.operators import projections as prj
from marlstone.plans.fixtures import MCQ_SQL, RESPONSES_SQL, RESULTS_SQL, documents, mcq, options, responses, results, table
from marlstone.plans.registry import query

BOX = r"\\boxed\{([A-D])\}"
_Q = MCQ_SQL
_R = RESPONSES_SQL


@query("s_fn_01_extract_direct", rf"SELECT doc_id, coalesce(nullif(regexp_extract(response, '{BOX}', 1), ''), nullif(regexp_extract(response, '([A-D])', 1), '')) AS letter FROM {_R}")
def _(spark, d):
    return responses(spark, d).select("doc_id", answers.extract_direct(F.col("response")).alias("letter"))


@query(
    "s_fn_02_extract_cot",
    rf"SELECT doc_id, coalesce(regexp_extract_all(response, '{BOX}', 1)[-1], regexp_extract_all(right(response, 200), '([A-D])', 1)[-1]) AS letter FROM {_R}",
)
def _(spark, d):
    return responses(spark, d).select("doc_id", answers.extract_cot(F.col("response")).alias("letter"))


_FN3 = " ".join(rf"WHEN {n} THEN coalesce(nullif(regexp_extract(response, '\\boxed\{{([A-{chr(64 + n)}])\}}', 1), ''), nullif(regexp_extract(response, '([A-{chr(64 + n)}])', 1), ''))" for n in range(2, 8))


@query("s_fn_03_extract_n_options", f"SELECT doc_id, CASE 2 + doc_id % 6 {_FN3} END AS letter FROM {_R}")
def _(spark, d):
    return responses(spark, d).select("doc_id", answers.extract_for_options(F.col("response"), F.col("doc_id") % 6 + 2).alias("letter"))


@query(
    "s_fn_04_vote",
    f"""WITH c AS (SELECT question_id, model, pred, count(*) AS n FROM {RESULTS_SQL} WHERE pred IS NOT NULL GROUP BY ALL)
SELECT k.question_id, k.model, v.pred AS voted FROM (SELECT DISTINCT question_id, model FROM {RESULTS_SQL}) k LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY question_id, model ORDER BY n DESC, pred) = 1) v USING (question_id, model)""",
)
def _(spark, d):
    return results(spark, d).groupBy("question_id", "model").agg(F.collect_list("pred").alias("a")).select("question_id", "model", answers.vote(F.col("a")).alias("voted"))


@query("s_fn_05_bounded_letter", rf"SELECT doc_id, nullif(regexp_extract(response, '\b([ABCD])\b', 1), '') AS letter FROM {_R}")
def _(spark, d):
    return responses(spark, d).select("doc_id", answers.bounded_letter(F.col("response")).alias("letter"))


@query("s_fn_06_reward_extraction", rf"SELECT doc_id, nullif(regexp_extract(response, '\\boxed\{{([A-Z])\}}', 1), '') AS letter, coalesce(regexp_matches(response, '\\boxed\{{([A-Z])\}}'), FALSE) AS fmt_ok FROM {_R}")
def _(spark, d):
    letter = answers.boxed_letter(F.col("response"))
    return responses(spark, d).select("doc_id", letter.alias("letter"), letter.isNotNull().alias("fmt_ok"))


@query("s_fn_07_has_boxed", rf"SELECT doc_id, coalesce(regexp_matches(response, '\\boxed\{{[A-D]\}}'), FALSE) AS boxed FROM {_R}")
def _(spark, d):
    return responses(spark, d).select("doc_id", answers.has_boxed(F.col("response")).alias("boxed"))


_JSON = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure: ```json ' || props || ' ```' WHEN 1 THEN 'x ' || props || ' y' WHEN 2 THEN 'no object' ELSE '{broken' END AS t FROM events"


def _json_rows(spark, d):
    k, p = F.col("event_id") % 4, F.col("props")
    t = F.when(k == 0, F.concat(F.lit("Sure: ```json "), p, F.lit(" ```"))).when(k == 1, F.concat(F.lit("x "), p, F.lit(" y"))).when(k == 2, "no object").otherwise("{broken")
    return table(spark, d, "events").select("event_id", t.alias("t"))


_TEXT = r"coalesce(nullif(regexp_extract(t, '(?is)```(?:json)?\s*(.*?)\s*```', 1), ''), nullif(regexp_extract(t, '(?s)\{.*\}', 0), ''))"


@query("s_fn_08_json_extract", rf"SELECT event_id, CASE WHEN json_valid({_TEXT}) THEN CAST(json_extract_string({_TEXT}, '$.k') AS BIGINT) END AS k FROM ({_JSON})")
def _(spark, d):
    return _json_rows(spark, d).select("event_id", F.try_variant_get(jsontext.parsed(F.col("t")), "$.k", "bigint").alias("k"))


@query("s_fn_09_json_text_greedy_and_not", rf"SELECT event_id, {_TEXT} AS greedy, {_TEXT.replace('.*\\}', '.*?\\}')} AS short FROM (SELECT event_id, t || ' {{}}' AS t FROM ({_JSON}))".replace("{{}}", "{}"))
def _(spark, d):
    t = F.concat("t", F.lit(" {}"))
    return _json_rows(spark, d).select("event_id", jsontext.json_text(t).alias("greedy"), jsontext.json_text(t, greedy=False).alias("short"))


@query("s_fn_10_verdict_validation", "SELECT doc_id, doc_id % 3 = 0 AS valid, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS good FROM documents")
def _(spark, d):
    """Every third verdict is whole; the others have a string for a boolean, or lack a key."""
    good = F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false")
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(', "overall_good": '), good)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(', "overall_good": "'), good, F.lit('"'))).otherwise("")
    t = F.concat(F.lit('{"is_tom": true, "unique_gold": true, "distractors_plausible": false'), tail, F.lit("}"))
    v = jsontext.verdict(t)
    return documents(spark, d).select("doc_id", v.isNotNull().alias("valid"), v["overall_good"].alias("good"))


def _json_of(rows, gold="gold"):
    return F.to_json(F.struct("story", "question", F.create_map(*(x for c in "ABCD" for x in (F.lit(c), F.col(f"opt_{c.lower()}")))).alias("options"), F.col(gold).alias("answer")))


@query("s_fn_11_mcq_object", f"SELECT question_id, CASE WHEN doc_id % 7 <> 0 THEN opt_b END AS opt_b, CASE WHEN doc_id % 7 <> 0 THEN gold END AS gold FROM {_Q}")
def _(spark, d):
    """Answers in lower case with blanks are read; every seventh has a letter that isn't an option."""
    rows = mcq(spark, d).withColumn("a", F.when(F.col("doc_id") % 7 == 0, "E").otherwise(F.concat(F.lit(" "), F.lower("gold"))))
    o = jsontext.mcq_object(_json_of(rows, "a"))
    return rows.select("question_id", o["opt_b"].alias("opt_b"), o["gold"].alias("gold"))


@query("s_fn_12_option_list_object", f"SELECT question_id, CASE WHEN doc_id % 4 < 3 AND trim(opt_a) <> '' AND trim(opt_b) <> '' AND trim(opt_c) <> '' THEN chr(CAST(65 + doc_id % 4 AS INT)) END AS gold, CASE WHEN doc_id % 4 < 3 AND trim(opt_a) <> '' AND trim(opt_b) <> '' AND trim(opt_c) <> '' THEN 'Where is Ann?' END AS question FROM {_Q}")
def _(spark, d):
    """Three options and an index from 0, which is out of range in every fourth row."""
    rows = options(mcq(spark, d))
    t = F.to_json(F.struct(F.lit("s").alias("story"), F.lit("Where is {subject}?").alias("question"), F.slice("options", 1, 3).alias("options"), (F.col("doc_id") % 4).alias("gold")))
    t = F.concat(F.lit("```json\n"), t, F.lit("\n```"))
    o = jsontext.option_list_object(t, 3, F.lit("Ann"))
    return rows.select("question_id", o["gold"].alias("gold"), o["question"].alias("question"))


@query("s_fn_13_flat_object", f"SELECT question_id, trim(story) <> '' AND trim(opt_a) <> '' AND trim(opt_b) <> '' AND trim(opt_c) <> '' AND trim(opt_d) <> '' AS valid FROM {_Q}")
def _(spark, d):
    t = F.to_json(F.struct("story", "question", "opt_a", "opt_b", "opt_c", "opt_d", "gold"))
    return mcq(spark, d).select("question_id", jsontext.flat_object(t).isNotNull().alias("valid"))


@query("s_fn_14_translation_object", f"SELECT question_id, doc_id % 5 <> 0 AS kept FROM {_Q}")
def _(spark, d):
    rows = mcq(spark, d).withColumn("a", F.when(F.col("doc_id") % 5 == 0, F.when(F.col("gold") == "A", "B").otherwise("A")).otherwise(F.col("gold")))
    return rows.select("question_id", jsontext.translation_object(_json_of(rows, "a"), F.col("gold")).isNotNull().alias("kept"))


_TRACE = f"(SELECT question_id, '<reasoning>' || story || '</reasoning> <answer>' || gold || '</answer>' AS t FROM {_Q})"


@query("s_fn_15_trace_parse", f"SELECT question_id, nullif(trim(regexp_extract(t, '(?s)<reasoning>(.*?)</reasoning>', 1), e' \\n\\r\\t'), '') AS reasoning, nullif(trim(regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1)), '') AS answer FROM {_TRACE}")
def _(spark, d):
    t = F.concat(F.lit("<reasoning>"), "story", F.lit("</reasoning> <answer>"), "gold", F.lit("</answer>"))
    return mcq(spark, d).select("question_id", prompts.trace_parts(t).alias("p")).select("question_id", "p.*")


def _rendered(spark, d, keep=True):
    rows = options(mcq(spark, d)).withColumn("story", F.regexp_replace("story", r"[ \n\r\t]+", " ")).withColumn("language", F.when(F.col("doc_id") % 2 == 0, "zh").otherwise("en"))
    return rows.withColumn("prompt", prompts.user_prompt(F.col("story"), F.col("question"), F.col("options"), F.col("language"), keep))


@query("s_fn_16_prompt_fields", rf"SELECT question_id, trim(regexp_replace(story, '[ \n\r\t]+', ' ', 'g')) AS story, question, len(list_filter([opt_a, opt_b, opt_c, opt_d], lambda o: TRUE)) AS n_options FROM {_Q}")
def _(spark, d):
    """Rendered and read back."""
    return _rendered(spark, d).select("question_id", prompts.prompt_fields(F.col("prompt")).alias("p")).select("question_id", "p.story", "p.question", F.size("p.options").cast("long").alias("n_options"))


@query("s_fn_17_prompt_fields_strict", rf"SELECT question_id, CASE WHEN doc_id % 2 = 1 AND '' NOT IN (opt_a, opt_b, opt_c, opt_d) THEN opt_c END AS opt_c FROM {_Q}")
def _(spark, d):
    p = prompts.prompt_fields_strict(F.col("prompt"))
    return _rendered(spark, d).select("question_id", F.when(~F.array_contains("options", ""), p["opt_c"]).alias("opt_c"))


@query("s_fn_18_before_marker", "SELECT doc_id, string_split(coalesce(text, ''), '. ')[1] AS head FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.before_marker(F.coalesce("text", F.lit("")), ". ").alias("head"))


@query("s_fn_19_split_choices", f"SELECT question_id, [trim(opt_a), trim(opt_b)] AS choices FROM {_Q} WHERE NOT regexp_matches(opt_a || opt_b, ',|[A-Z][.]')")
def _(spark, d):
    rows = mcq(spark, d).where(~F.concat("opt_a", "opt_b").rlike(",|[A-Z][.]"))
    return rows.select("question_id", text.split_choices(F.concat(F.lit("A. "), "opt_a", F.lit(", B. "), "opt_b")).alias("choices"))


@query("s_fn_20_answer_letter", f"SELECT question_id, CASE lower(trim(opt_c)) WHEN lower(trim(opt_a)) THEN 'A' WHEN lower(trim(opt_b)) THEN 'B' ELSE 'C' END AS letter FROM {_Q}")
def _(spark, d):
    return options(mcq(spark, d)).select("question_id", answers.answer_letter(F.concat(F.lit(" "), "opt_c"), F.col("options")).alias("letter"))


@query("s_fn_21_label_letter", f"SELECT question_id, CASE WHEN trim(opt_d) = trim(opt_a) THEN 'A' WHEN trim(opt_d) = trim(opt_b) THEN 'B' WHEN trim(opt_d) = trim(opt_c) THEN 'C' ELSE 'D' END AS letter FROM {_Q}")
def _(spark, d):
    return options(mcq(spark, d)).select("question_id", answers.label_letter(F.col("opt_d"), F.col("options")).alias("letter"))


_NAMED = "CASE WHEN regexp_full_match(trim(opt_c), '[+]?0*[0-3]') THEN chr(CAST(65 + CAST(right(trim(opt_c), 1) AS INT) AS INT)) WHEN regexp_full_match(trim(opt_c), '[A-Da-d]') THEN upper(trim(opt_c)) ELSE CASE lower(trim(opt_c)) WHEN lower(trim(opt_a)) THEN 'A' WHEN lower(trim(opt_b)) THEN 'B' ELSE 'C' END END"


@query("s_fn_22_any_gold_letter", f"SELECT question_id, CASE WHEN doc_id % 3 < 2 THEN chr(CAST(65 + doc_id % 4 AS INT)) ELSE {_NAMED} END AS letter FROM {_Q}")
def _(spark, d):
    """Every question: an index in one third of rows, a letter in another, an option's text in the last."""
    k = F.col("doc_id") % 3
    gold = F.when(k == 0, (F.col("doc_id") % 4).cast("string")).when(k == 1, F.lower("gold")).otherwise(F.col("opt_c"))
    return options(mcq(spark, d)).select("question_id", answers.any_gold_letter(gold, F.col("options")).alias("letter"))


@query("s_fn_23_numbered_letter", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE chr(CAST(65 + doc_id % 5 AS INT)) END AS letter FROM documents")
def _(spark, d):
    label = F.when(F.col("doc_id") % 5 == 4, "none").otherwise((F.col("doc_id") % 5 + 1).cast("string"))
    return documents(spark, d).select("doc_id", answers.numbered_letter(label).alias("letter"))


@query("s_fn_24_strip_parenthesis", r"SELECT doc_id, regexp_replace(source || ' (' || lang || ') ', '\s*\([^)]*\)\s*$', '') AS name FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.strip_trailing_parenthesis(F.concat("source", F.lit(" ("), "lang", F.lit(") "))).alias("name"))


@query("s_fn_25_tuple_items", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [source, lang] END AS items FROM documents")
def _(spark, d):
    literal = F.concat(F.when(F.col("doc_id") % 2 == 0, "(").otherwise("["), F.lit("'"), "source", F.lit("', '"), "lang", F.lit("')"))
    return documents(spark, d).select("doc_id", text.tuple_items(literal).alias("items"))


_QT = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Yes or no: is it there?' WHEN 1 THEN 'Who knows about the box?' WHEN 2 THEN 'Where is it?' ELSE 'Is it there?' END AS q, CASE doc_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Ann does not know about it' WHEN 2 THEN 'box' ELSE 'no' END AS a FROM documents)"


def _questions(spark, d):
    k = F.col("doc_id") % 4
    q = F.when(k == 0, "Yes or no: is it there?").when(k == 1, "Who knows about the box?").when(k == 2, "Where is it?").otherwise("Is it there?")
    a = F.when(k == 0, "Yes").when(k == 1, "Ann does not know about it").when(k == 2, "box").otherwise("no")
    return documents(spark, d).select("doc_id", q.alias("q"), a.alias("a"))


@query("s_fn_26_question_type", "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN 'yes_no' WHEN doc_id % 4 = 1 THEN 'knowledge' ELSE 'container' END AS kind FROM documents")
def _(spark, d):
    return _questions(spark, d).select("doc_id", text.question_type(F.col("q"), F.col("a")).alias("kind"))


@query(
    "s_fn_27_rule_distractors",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['no', 'I don''t know', 'It''s unclear from the story'] WHEN 1 THEN ['knows about it', 'I don''t know', 'It depends on context'] WHEN 3 THEN ['yes', 'I don''t know', 'It''s unclear from the story'] END AS wrong FROM documents",
)
def _(spark, d):
    q = _questions(spark, d)
    return q.select("doc_id", text.rule_distractors(text.question_type(F.col("q"), F.col("a")), F.col("a")).alias("wrong"))


@query("s_fn_28_strip_articles", f"SELECT question_id, regexp_replace(regexp_replace(regexp_replace(lower(trim('The ' || opt_a)), '^the ', ''), '^a ', ''), '^an ', '') AS name FROM {_Q}")
def _(spark, d):
    return mcq(spark, d).select("question_id", text.strip_articles(F.concat(F.lit("The "), "opt_a")).alias("name"))


@query("s_fn_29_rough_tokens", r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_extract_all(text, '\s')) + 1 + len(regexp_extract_all(text, '[\x{3000}-\x{9FFF}]')) // 2 END AS n FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.rough_tokens(F.col("text")).alias("n"))


_SIG = "1 / (1 + exp(-({})))"


@query("s_fn_30_sigmoid", "SELECT event_id, 1 / (1 + exp(-(value - 20))) AS s FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", reward.sigmoid(F.col("value") - 20).alias("s"))


_WIN = "(1 / (1 + exp(-(50 * (n_chars - 8) / greatest(1, m - 8))))) * (1 - 1 / (1 + exp(-(50 * (n_chars - m) / greatest(1, m - 8)))))"


@query("s_fn_31_length_window", f"SELECT doc_id, {_WIN} AS w FROM (SELECT doc_id, n_chars, 4096.0 AS m FROM documents)")
def _(spark, d):
    return documents(spark, d).select("doc_id", reward.length_window(F.col("n_chars"), F.lit(8.0), F.lit(4096.0), 50.0).alias("w"))


@query(
    "s_fn_32_reward",
    rf"""SELECT doc_id, r_fmt, r_out, r_len, r_fmt * r_out * r_len AS r_total, 0.05 * r_fmt + 0.85 * r_out + 0.1 * r_len AS r_weighted FROM (SELECT doc_id, CAST(CASE WHEN l IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS r_fmt,
CAST(CASE WHEN l = gold THEN 1 ELSE 0 END AS DOUBLE) AS r_out, {_WIN} AS r_len FROM (SELECT *, 256.0 AS m, nullif(regexp_extract(response, '\\boxed\{{([A-Z])\}}', 1), '') AS l FROM {_R}))""",
)
def _(spark, d):
    rows = responses(spark, d)
    args = (F.col("response"), F.col("n_chars"), F.col("gold"), F.lit(256.0))
    r = reward.reward(*args, reward.RewardParameters())
    w = reward.reward(*args, reward.RewardParameters().override({"aggregation": "weighted_sum", "unknown": 1}))
    return rows.select("doc_id", r.alias("r"), w["r_total"].alias("r_weighted")).select("doc_id", "r.*", "r_weighted")


@query("s_fn_33_effective_l_max", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 64 WHEN doc_id % 4 IN (1, 2) THEN 2048 ELSE 256 END::DOUBLE AS l_max FROM documents")
def _(spark, d):
    k = F.col("doc_id") % 4
    source, task = F.when(k == 0, "HiToM_Direct").when(k == 1, "hitom").otherwise("x"), F.when(k == 2, "order_3").otherwise("y")
    return documents(spark, d).select("doc_id", reward.effective_l_max(source, task, reward.RewardParameters(l_max_short=64.0, l_max_long=2048.0)).alias("l_max"))


@query("s_fn_34_override_merge", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS DOUBLE) ELSE {reward.RewardParameters().l_max}::DOUBLE END AS l_max, CASE WHEN doc_id % 2 = 0 THEN n_chars / 4 ELSE {reward.RewardParameters().k}::DOUBLE END AS k FROM documents")
def _(spark, d):
    """Each row overrides some of the parameters by strings, and one that there is not."""
    given = F.create_map(F.when(F.col("doc_id") % 3 == 0, "l_max").otherwise("nothing"), F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 0, "k").otherwise("none"), (F.col("n_chars") / 4).cast("string"))
    p = reward.RewardParameters().override_by(given)
    return documents(spark, d).select("doc_id", p["l_max"].alias("l_max"), p["k"].alias("k"))


@query("s_fn_35_non_pad_count", "SELECT vec_id, CAST(len(list_filter([vec_id % 3, vec_id % 2, 0, 5], lambda x: x <> 0)) AS INT) AS n FROM embeddings")
def _(spark, d):
    ids = F.array(F.col("vec_id") % 3, F.col("vec_id") % 2, F.lit(0), F.lit(5))
    return table(spark, d, "embeddings").select("vec_id", text.non_pad_count(ids).alias("n"))


@query("s_fn_36_cache_key", f"SELECT question_id, model, 'org_' || model || '_v1__' || protocol || '__' || question_id || '__s0' AS key FROM {RESULTS_SQL}")
def _(spark, d):
    r = results(spark, d)
    return r.select("question_id", "model", text.cache_key(F.concat(F.lit("org/"), "model", F.lit(":v1")), F.col("protocol"), F.col("question_id"), F.lit("s0")).alias("key"))


@query("s_fn_37_wrap_think", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<think>' || source || '</think>' || chr(10) || lang ELSE lang END AS t FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.wrap_think(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("lang")).alias("t"))


@query("s_fn_38_interpolate", "SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: 0.75 * CAST(z[1] AS DOUBLE) + 0.25 * CAST(z[2] AS DOUBLE)) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", text.interpolate(F.col("embedding"), F.col("b"), 0.25).alias("v"))


@query("s_fn_38_weight_shards", "SELECT 'v' || a.vec_id AS name, list_transform(list_zip(a.embedding, b.embedding), lambda z: 0.75 * CAST(z[1] AS DOUBLE) + 0.25 * CAST(z[2] AS DOUBLE)) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    """Vectors as tensors of a shard for each label; those of the next ids are blended in, by name, from files of their own."""
    from marlstone.plans.q_io import _place
    from marlstone.sources import tensors

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    both = e.join(nxt, "vec_id")
    folders = [_place(spark), _place(spark)]
    for path, v in zip(folders, ("v", "w"), strict=True):
        tensors.write_tensors(tensors.from_arrays(both.select(F.concat(F.lit("labels-"), F.coalesce("label", F.lit(-1)), F.lit(".safetensors")).alias("shard"), F.concat(F.lit("v"), "vec_id").alias("name"), F.col(v).alias("v"))), path)
    return tensors.to_arrays(tensors.blend(*(tensors.read_tensors(spark, p) for p in folders), 0.25)).select("name", "v")


@query("s_fn_39_text_hash", "SELECT doc_id, left(sha256(text), 16) AS h FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.text_hash(F.col("text")).alias("h"))


@query("s_fn_40_sampling_parameters", f"SELECT question_id, model, protocol, CASE protocol WHEN 'direct' THEN 64 ELSE 8192 END AS max_tokens, CASE protocol WHEN 'direct' THEN 0.0 WHEN 'cot' THEN 0.6 ELSE 0.7 END::DOUBLE AS temperature FROM {RESULTS_SQL}")
def _(spark, d):
    p = text.sampling_parameters(F.when(F.col("protocol") == "vote", "del_tom").otherwise(F.col("protocol")), text.PROTOCOLS)
    return results(spark, d).select("question_id", "model", "protocol", p["max_tokens"].alias("max_tokens"), p["temperature"].alias("temperature"))


@query("s_fn_41_format_points", "SELECT doc_id, printf('%.2f%%', x * 100) AS rate, printf('%+.2f', (x - 0.5) * 100) AS points FROM (SELECT doc_id, CAST(doc_id % 64 AS DOUBLE) / 64 AS x FROM documents)")
def _(spark, d):
    x = (F.col("doc_id") % 64).cast("double") / 64
    return documents(spark, d).select("doc_id", text.percent(x).alias("rate"), text.signed_points(x - 0.5).alias("points"))


@query("s_fn_42_sentence_and_step_count", "SELECT doc_id, CAST(greatest(1, len(regexp_extract_all(text, '[.。！!]'))) AS INT) AS sentences, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(ltrim(l), '^(Step|步骤)'))) AS INT) AS steps FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.sentence_count(F.col("text")).alias("sentences"), text.step_lines(F.coalesce("text", F.lit(""))).alias("steps"))


# projections


@query("s_prj_01_first_text", "SELECT doc_id, coalesce(nullif(CASE WHEN lower(trim(a)) <> 'nan' THEN trim(a) END, ''), nullif(trim(lang), ''), '') AS t FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE ' x ' END AS a FROM documents)")
def _(spark, d):
    k = F.col("doc_id") % 4
    a = F.when(k == 0, "NaN").when(k == 1, "  ").when(k == 3, " x ")
    return documents(spark, d).select("doc_id", text.first_text(a, F.col("lang")).alias("t"))


_BI = f"(SELECT question_id, CASE WHEN doc_id % 9 = 0 THEN 'X' ELSE gold END AS gold, story AS story_en, question AS question_en, opt_a AS opt_a_en, CASE WHEN doc_id % 3 = 0 THEN story END AS story_zh, question AS question_zh, opt_a AS opt_a_zh FROM {_Q})"


@query(
    "s_prj_02_unpivot_languages",
    f"SELECT question_id, gold, language, trim(coalesce(story, '')) AS story, trim(question) AS question, trim(opt_a) AS opt_a FROM (SELECT question_id, gold, 'en' AS language, story_en AS story, question_en AS question, opt_a_en AS opt_a FROM {_BI} UNION ALL SELECT question_id, gold, 'zh', story_zh, question_zh, opt_a_zh FROM {_BI}) WHERE gold IN ('A', 'B', 'C', 'D') AND trim(coalesce(story, '')) <> '' AND trim(question) <> '' AND trim(opt_a) <> ''",
)
def _(spark, d):
    q = mcq(spark, d)
    cols = [F.col(c).alias(f"{c}_{x}") for x in ("en", "zh") for c in ("question", "opt_a")]
    wide = q.select("question_id", F.when(F.col("doc_id") % 9 == 0, "X").otherwise(F.col("gold")).alias("gold"), F.col("story").alias("story_en"), F.when(F.col("doc_id") % 3 == 0, F.col("story")).alias("story_zh"), *cols)
    fields = ("story", "question", "opt_a")
    return prj.unpivot_languages(wide, fields, needed=fields)


@query("s_prj_03_split_subtasks", f"SELECT question_id, 'emotion' AS subtask, opt_a AS label FROM {_Q} UNION ALL SELECT question_id, 'cause', opt_b FROM {_Q}")
def _(spark, d):
    rows = mcq(spark, d).select("question_id", "opt_a", "opt_b")
    return prj.split_subtasks(rows, {"emotion": {"label": F.col("opt_a")}, "cause": {"label": F.col("opt_b")}}).select("question_id", "subtask", "label")


_AB = "(SELECT doc_id, ['Belief: Location false beliefs', 'Belief: other', 'Desire x', 'Emotion', 'Non-Literal Communication: irony', 'Knowledge:y'][CAST(1 + doc_id % 6 AS INT)] AS a FROM documents)"


@query("s_prj_04_category", f"SELECT doc_id, CASE WHEN a = 'Belief: Location false beliefs' THEN 'False Belief' WHEN a LIKE 'Belief:%' THEN 'Belief' WHEN a LIKE 'Desire %' THEN 'Desire' WHEN a LIKE 'Non-Literal Communication:%' THEN 'Non-literal Comm' WHEN a LIKE 'Knowledge:%' THEN 'Knowledge' ELSE 'Other' END AS task FROM {_AB}")
def _(spark, d):
    names = ("Belief: Location false beliefs", "Belief: other", "Desire x", "Emotion", "Non-Literal Communication: irony", "Knowledge:y")
    a = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 6).cast("int"))
    return documents(spark, d).select("doc_id", prj.category(a, prj.ABILITIES, prj.PREFIXES).alias("task"))


@query("s_prj_05_belief_label", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Knowledge' WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'False Belief' ELSE 'Belief' END WHEN 2 THEN CASE WHEN doc_id % 5 = 0 THEN 'False Belief' ELSE 'Belief' END ELSE 'Belief' END AS task FROM documents")
def _(spark, d):
    k = F.col("doc_id") % 4
    order = F.when(k == 0, "-1").otherwise(k.cast("string"))
    flag = lambda m: F.when(F.col("doc_id") % m == 0, "TRUE").otherwise("false")
    return documents(spark, d).select("doc_id", prj.belief_label(order, flag(3), flag(5)).alias("task"))


@query("s_prj_06_ordinal_id", "SELECT doc_id, printf('hitom_%06d', doc_id) AS id FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", prj.ordinal_id("hitom_", F.col("doc_id")).alias("id"))


@query("s_prj_07_sequential_id", "SELECT doc_id, 'syn_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id FROM documents")
def _(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return documents(spark, d).select("doc_id", F.concat(F.lit("syn_"), n).alias("id"))


_LINES = "'A. ' || opt_a || chr(10) || 'B. ' || opt_b || chr(10) || 'C. ' || opt_c || chr(10) || 'D. ' || opt_d"
_EN = f"'Story:' || chr(10) || story || chr(10) || chr(10) || 'Question: ' || question || chr(10) || {_LINES}"
_ZH = f"'故事：' || chr(10) || story || chr(10) || chr(10) || '问题：' || question || chr(10) || {_LINES}"


@query("s_prj_08_user_prompt", f"SELECT question_id, CASE WHEN doc_id % 2 = 0 THEN {_ZH} ELSE {_EN} END AS prompt FROM {_Q}")
def _(spark, d):
    rows = options(mcq(spark, d))
    lang = F.when(F.col("doc_id") % 2 == 0, "zh").otherwise("en")
    return rows.select("question_id", prompts.user_prompt(F.col("story"), F.col("question"), F.col("options"), lang, keep_empty_story=True).alias("prompt"))


@query("s_prj_09_user_prompt_options", f"SELECT question_id, CASE WHEN doc_id % 2 = 0 THEN 'Question: ' || question || chr(10) || 'A. ' || opt_a || chr(10) || 'B. ' || opt_b ELSE 'Story:' || chr(10) || source || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'A. ' || opt_a || chr(10) || 'B. ' || opt_b END AS prompt FROM {_Q}")
def _(spark, d):
    rows = options(mcq(spark, d))
    story = F.when(F.col("doc_id") % 2 == 1, F.col("source")).otherwise("")
    return rows.select("question_id", prompts.user_prompt(story, F.col("question"), F.slice("options", 1, 2), F.lit("en")).alias("prompt"))


@query("s_prj_10_letter_list", "SELECT doc_id, array_to_string(list_transform(range(0, 2 + doc_id % 5), lambda i: chr(CAST(65 + i AS INT))), ', ') AS letters FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", prompts.letter_list((F.col("doc_id") % 5 + 2).cast("int")).alias("letters"))


@query("s_prj_11_chat_messages", f"SELECT question_id, 2 AS n, 'system,user' AS roles, length({_EN}) AS user_length FROM {_Q}")
def _(spark, d):
    chat = prj.to_chat(mcq(spark, d).withColumn("language", F.lit("en")))
    return chat.select("question_id", F.size("messages").alias("n"), F.array_join("messages.role", ",").alias("roles"), F.length(F.element_at("messages", 2)["content"]).cast("long").alias("user_length"))


@query("s_prj_12_first_of_role", "SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'system'), '') AS system FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return c.select("conv_id", prompts.first_of_role(F.col("messages"), "system").alias("system"))


@query("s_prj_13_to_chat", f"SELECT question_id, gold AS ground_truth, 'mcq' AS tag, task, {_EN} AS user FROM {_Q}")
def _(spark, d):
    chat = prj.to_chat(mcq(spark, d).withColumn("language", F.lit("en")))
    return chat.select("question_id", "ground_truth", "tag", "task", prompts.first_of_role(F.col("messages"), "user").alias("user"))


@query("s_prj_14_to_chat_options", f"SELECT question_id, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE CASE WHEN story = '' THEN '' ELSE 'Story:' || chr(10) || story || chr(10) || chr(10) END || 'Question: ' || question || chr(10) || {_LINES} END AS user FROM {_Q}")
def _(spark, d):
    rows = options(mcq(spark, d)).withColumn("language", F.lit("en")).withColumn("messages", F.when(F.col("doc_id") % 4 == 0, prompts.chat(F.lit("s"), F.lit("kept"))))
    return prj.to_chat_options(rows).select("question_id", prompts.first_of_role(F.col("messages"), "user").alias("user"))


@query("s_prj_15_to_sft", f"SELECT question_id, '<reasoning>' || chr(10) || story || chr(10) || '</reasoning>' || chr(10) || chr(10) || gold AS response FROM {_Q}")
def _(spark, d):
    rows = options(mcq(spark, d)).withColumn("reasoning", F.col("story")).withColumn("final", F.col("gold"))
    return prj.to_sft(rows).select("question_id", "response")


@query("s_prj_16_style_variant", f"SELECT question_id || '_direct' AS question_id, 'direct' AS source, len(regexp_extract_all({_EN}, '\\n[A-Z]\\.\\s')) AS letters FROM {_Q}")
def _(spark, d):
    v = prj.style_variant(prj.to_chat(mcq(spark, d).withColumn("language", F.lit("en"))), prompts.SYSTEM_DIRECT, "direct", "_direct")
    return v.select("question_id", "source", prompts.prompt_letters(prompts.first_of_role(F.col("messages"), "user")).cast("long").alias("letters"))


@query("s_prj_17_strip_option_prefix", f"SELECT question_id, regexp_replace('b: ' || opt_a, '(?i)^\\s*[A-D][.．、:：]\\s*', '') AS o FROM {_Q}")
def _(spark, d):
    return mcq(spark, d).select("question_id", text.strip_option_prefix(F.concat(F.lit("b: "), "opt_a")).alias("o"))


@query("s_prj_18_match_text", f"SELECT question_id, concat_ws(' ', question, CASE WHEN doc_id % 2 = 0 THEN opt_a END, opt_b, opt_c, opt_d) AS t FROM {_Q}")
def _(spark, d):
    a = F.when(F.col("doc_id") % 2 == 0, F.col("opt_a"))
    return mcq(spark, d).select("question_id", prj.match_text(F.col("question"), a, F.col("opt_b"), F.col("opt_c"), F.col("opt_d")).alias("t"))


@query("s_prj_19_match_text_story", f"SELECT question_id, story || question || coalesce(CASE WHEN doc_id % 2 = 0 THEN opt_a END, '') AS t FROM {_Q}")
def _(spark, d):
    a = F.when(F.col("doc_id") % 2 == 0, F.col("opt_a"))
    return mcq(spark, d).select("question_id", prj.match_text(F.col("story"), F.col("question"), a, blank_nulls=True).alias("t"))


@query("s_prj_20_conversation_key", "SELECT conv_id, string_agg(role || '::' || text, '|||' ORDER BY turn) AS key FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return c.select("conv_id", prompts.conversation_key(F.col("messages")).alias("key"))


@query("s_prj_21_drop_private", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    return prj.drop_private(documents(spark, d).select("doc_id", "lang", F.lit(1).alias("_meta"), F.lit(2).alias("_n")))


@query("s_prj_22_retag", "SELECT count(*) AS n, count(*) FILTER (lang <> 'en') AS changed FROM documents")
def _(spark, d):
    rows = documents(spark, d).withColumn("tag", F.col("lang"))
    _, changed = prj.retag(rows, "en")
    return rows.agg(F.count("*").alias("n"), changed)


@query("s_prj_23_relabel", "SELECT d.doc_id AS question_id, CASE WHEN l.quality IS NOT NULL THEN 'q' || l.quality ELSE source END AS task, l.quality IS NOT NULL AS changed FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    fresh = table(spark, d, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("question_id"), F.concat(F.lit("q"), "quality").alias("task"))
    return prj.relabel(documents(spark, d).select(F.col("doc_id").alias("question_id"), F.col("source").alias("task")), fresh)


@query("s_prj_24_fill_options", f"SELECT question_id, CASE WHEN doc_id % 6 = 0 OR '' IN (trim(opt_a), trim(opt_b), trim(opt_c), trim(opt_d)) THEN 'none' ELSE opt_a END AS opt_a FROM {_Q}")
def _(spark, d):
    rows = mcq(spark, d).withColumn("language", F.lit("en")).withColumn("opt_d", F.when(F.col("doc_id") % 6 == 0, " ").otherwise(F.col("opt_d")))
    return prj.fill_options(rows, {"en": ("none", "one", "two", "three")}).select("question_id", "opt_a")


@query("s_prj_25_truncate", "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS t FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.truncate(F.col("text"), 60).alias("t"))
