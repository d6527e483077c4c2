"""One query for each operator over its whole tables, with DuckDB SQL where that can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bin_packing, decontaminate, filter_audit, jaccard_join, language_id, packing, preferences, quality_classifier, quality_rules, substring_dedup, token_count, url_filter, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Distinct 5-word shingles of the rows of a relation (id, w).
_SHINGLES = "SELECT DISTINCT id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {} WHERE len(w) > 0)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A level's prior strength from its groups g(n, k, prior).
_RHO = "SELECT CASE WHEN sum(CASE WHEN prior * (1 - prior) > 0 THEN 1 END) IS NULL OR sum(n) = count(*) THEN 0.001 ELSE (sum(CASE WHEN prior * (1 - prior) > 0 THEN n * (k / n - prior) ** 2 / (prior * (1 - prior)) END) - count(*)) / (sum(n) - count(*)) END AS rho FROM {} WHERE n > 0"
_STRENGTH = "(SELECT 1 / least(greatest(rho, 0.001), 1 / 3) - 1 FROM ({}))"


_WIDE = ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES)


@register(
    f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, coalesce(html, '') AS html FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
  CAST(100 * len(regexp_extract_all(html, '[#*$%]')) > length(html) AS INT) AS bad FROM u),
h0 AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(bad) AS n, sum(bad) AS k FROM p GROUP BY host),
h1 AS (SELECT *, regexp_full_match(name, '[0-9]+(\\.[0-9]+){{3}}') AS number, array_to_string(string_split(name, '.')[-2:], '.') IN ({_WIDE}) AS wide FROM h0),
h AS (SELECT host, n, k, CASE WHEN number THEN name WHEN wide THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE array_to_string(string_split(name, '.')[-1:], '.') END AS suffix,
  CASE WHEN number THEN name WHEN wide THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain FROM h1),
t AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT sum(k) / sum(n) FROM h) AS prior FROM h GROUP BY suffix),
t2 AS (SELECT suffix, (prior * s + k) / (s + n) AS prior FROM (SELECT *, {_STRENGTH.format(_RHO.format("t"))} AS s FROM t)),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, any_value(prior) AS prior FROM h JOIN t2 USING (suffix) GROUP BY suffix, domain),
d2 AS (SELECT suffix, domain, (prior * s + k) / (s + n) AS prior FROM (SELECT *, {_STRENGTH.format(_RHO.format("d"))} AS s FROM d)),
h2 AS (SELECT host, n, k, prior FROM h JOIN d2 USING (suffix, domain)),
h3 AS (SELECT host, prior * s + k AS a, (1 - prior) * s + n - k AS b FROM (SELECT *, {_STRENGTH.format(_RHO.format("h2"))} AS s FROM h2)),
r AS (SELECT page_id, host, path, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS blocked,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/' WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p JOIN h3 USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict FROM r"""
)
def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


@register(
    f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM win JOIN least USING (g) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digest(_table(spark, sf_dir, "documents"))


@register(
    f"""WITH d AS (SELECT doc_id AS id, {_WORDS.format(_LOWER)} AS w FROM documents),
b AS (SELECT item_id AS id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
dg AS ({_SHINGLES.format("d")}), bg AS ({_SHINGLES.format("b")}),
n AS (SELECT id, count(*) AS n FROM bg GROUP BY id),
s AS (SELECT dg.id AS doc_id, bg.id AS item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared, shared / n AS containment FROM s JOIN n ON n.id = item_id WHERE 100 * shared >= 80 * n"""
)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@register()
def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@register()
def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"))


@register(
    """WITH last AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
  CASE WHEN role = 'assistant' AND turn = l.last THEN coalesce(o.answer, '') ELSE text END AS other
  FROM conversations LEFT JOIN last l USING (conv_id) LEFT JOIN (SELECT conv_id - 1 AS conv_id, answer FROM last) o USING (conv_id)),
n AS (SELECT conv_id, coalesce(min(CASE WHEN text IS DISTINCT FROM other THEN i END) - 1, max(i)) AS n_common FROM c GROUP BY conv_id),
r AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, i <= n_common AS shared FROM c JOIN n USING (conv_id)),
s AS (SELECT *, length(head) + coalesce(sum(length(head) + length(text) + 1) OVER w, 0) AS a, length(head) + coalesce(sum(length(head) + length(other) + 1) OVER w, 0) AS b
  FROM r WINDOW w AS (PARTITION BY conv_id, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, CAST(any_value(n_common) AS INT) AS n_common, coalesce(string_agg(CASE WHEN shared THEN head || text || chr(10) END, '' ORDER BY i), '') AS prompt,
  coalesce(string_agg(CASE WHEN NOT shared THEN head || text || chr(10) END, '' ORDER BY i), '') AS chosen,
  coalesce(string_agg(CASE WHEN NOT shared AND role = 'assistant' AND text <> '' THEN a || ':' || length(text) END, ',' ORDER BY i), '') AS chosen_spans,
  coalesce(string_agg(CASE WHEN NOT shared THEN head || other || chr(10) END, '' ORDER BY i), '') AS rejected,
  coalesce(string_agg(CASE WHEN NOT shared AND role = 'assistant' AND other <> '' THEN b || ':' || length(other) END, ',' ORDER BY i), '') AS rejected_spans FROM s GROUP BY conv_id"""
)
def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.format_preferences(*preferences.swapped_answers(_table(spark, sf_dir, "conversations")))
    return out.withColumns({c: preferences.spans_as_text(c) for c in ("chosen_spans", "rejected_spans")})


@register()
def op7_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@register(
    f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {_WORDS.format(_LOWER)} AS w FROM documents),
g AS ({_SHINGLES.format("d")}), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT id AS a, id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), l AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS text_id, coalesce(n_links, 0) AS n_links
FROM documents JOIN c ON c.a = doc_id LEFT JOIN l ON l.a = doc_id LEFT JOIN n ON n.id = doc_id"""
)
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


_QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)}))) AS BIGINT) AS n_stop_words, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper FROM d),
c AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_stop_words, n_upper FROM m LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.15 AND n_stop_words >= 2 AND n_stop_words / n_words >= 0.02
  AND n_upper / word_chars <= 0.4 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AS kept FROM f"""


@register(_QUALITY)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


@register()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


@register()
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_best(_table(spark, sf_dir, "documents"))


@register(
    f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
m AS (SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS INT) AS mask FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, 1 << (instr('ABCDE', substr(o, step, 1)) - 1) AS bit, list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(o, i, 1)) - 1))) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o AS filter_order, CAST(step AS INT) AS step, any_value(bit) AS bit, coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0) > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS toxic_lost FROM c, s GROUP BY part, o, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_NEAREST = "SELECT r, part, min((d, entry)) AS best FROM (SELECT r, p.part, entry, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {} b ON b.part = p.part) GROUP BY r, part"
#: A round: assignments a{n} to the codebook b{n - 1}, and the codebook b{n}.
_ROUND = """a{n} AS (""" + _NEAREST.format("b{m}") + """),
f{n} AS (SELECT part, entry, list(CAST(floor(total / k) AS BIGINT) ORDER BY i) AS c FROM (SELECT part, best[2] AS entry, i, sum(q[i]) AS total, count(*) AS k FROM a{n} JOIN p USING (r, part), (SELECT unnest(range(1, 1 + (SELECT any_value(len(q)) FROM p))) AS i) GROUP BY ALL) GROUP BY part, entry),
b{n} AS (SELECT b.part, b.entry, coalesce(f.c, b.c) AS c FROM b{m} b LEFT JOIN f{n} f ON f.part = b.part AND f.entry = b.entry)"""


@register(
    f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS q FROM k, (SELECT unnest(range(0, 16)) AS part)),
b0 AS (SELECT part, r - 1 AS entry, q AS c FROM p WHERE r <= 64),
{_ROUND.format(n=1, m=0)}, {_ROUND.format(n=2, m=1)}, a3 AS ({_NEAREST.format("b2")}),
o AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a3 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM o JOIN k USING (r)"""
)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))
