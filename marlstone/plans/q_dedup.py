"""Queries of similarity, deduplication and decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import dedup, similarity as sim
from marlstone.operators.best_match import matches
from marlstone.operators.lineage import cut
from marlstone.plans.fixtures import MCQ_SQL, documents, mcq, table
from marlstone.plans.registry import query

_W = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"


def _grams(tokens: str, n: str = "4") -> str:
    return f"CASE WHEN len({tokens}) >= {n} THEN list_sort(list_distinct(list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string(({tokens})[i:i + {n} - 1], ' ')))) ELSE [] END"


_LOW = _W.format("lower(coalesce(text, ''))")
_SETS = f"(SELECT doc_id, source, list_distinct(g) AS g FROM (SELECT doc_id, source, {_grams('w')} AS g FROM (SELECT doc_id, source, {_LOW} AS w FROM documents)))"
_ITEMS = f"(SELECT item_id, {_grams('w')} AS g FROM (SELECT item_id, {_LOW} AS w FROM benchmark))"


def _docs(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("key"), "source", sim.word_grams(F.col("text")).alias("grams"))


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("key"), sim.word_grams(F.col("text")).alias("grams"))


_PAIRS = f"""dg AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM {_SETS}), ig AS (SELECT item_id, len(g) AS n, unnest(g) AS x FROM {_ITEMS}),
pair AS (SELECT doc_id, item_id, any_value(dg.n) AS na, any_value(ig.n) AS nb, count(*) AS s FROM dg JOIN ig USING (x) GROUP BY doc_id, item_id)"""


@query(
    "contamination_audit",
    f"""WITH {_PAIRS}, best AS (SELECT doc_id, max(s / (na + nb - s)) AS j, max(s / nb) AS c FROM pair GROUP BY doc_id),
v AS (SELECT source, coalesce(j, 0) AS j, coalesce(c, 0) AS c FROM documents LEFT JOIN best USING (doc_id))
SELECT source, count(*) AS n, avg(j) AS mean, max(j) AS max, list_sort(list(j))[1 + least(count(*) - 1, CAST(floor(95 * count(*) / 100) AS BIGINT))] AS p95,
count(*) FILTER (j >= 0.6) AS leaked, count(*) FILTER (c >= 0.6) AS contained FROM v GROUP BY source""",
)
def contamination_audit(spark, d):
    """Per source: how similar its documents are to the benchmark, and how many leak by Jaccard or contain an item."""
    docs = _docs(spark, d)
    best = cut(dedup.leakage(docs, _items(spark, d)).join(docs.select("key", "source"), "key"))
    flags = best.groupBy("source").agg(F.count_if("leaked").alias("leaked"), F.count_if(F.col("max_containment") >= 0.6).alias("contained"))
    return dedup.distribution(best, "source", "max_jaccard").join(flags, "source")


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query("s_sim_01_adaptive_grams", f"SELECT doc_id, len(g) AS n, g[1] AS first FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN {_grams('w', '1')} WHEN len(w) < 5 THEN {_grams('w', '3')} ELSE {_grams('w', '4')} END AS g FROM (SELECT doc_id, {_TOK} AS w FROM documents))")
def _(spark, d):
    g = F.array_sort(sim.adaptive_grams(F.col("text")))
    return documents(spark, d).select("doc_id", g.alias("g")).select("doc_id", F.size("g").cast("long").alias("n"), F.get("g", F.lit(0)).alias("first"))


@query("s_sim_03_word_grams_lower", f"SELECT doc_id, len(g) AS n FROM {_SETS}")
def _(spark, d):
    return _docs(spark, d).select(F.col("key").alias("doc_id"), F.size("grams").cast("long").alias("n"))


_WHOLE = f"(SELECT doc_id, question_id, story AS q FROM {MCQ_SQL})"


@query("s_sim_02_word_grams_cased", f"SELECT question_id, CASE WHEN len(w) < 4 AND q <> '' THEN [q] ELSE {_grams('w')} END AS g FROM (SELECT question_id, q, {_W.format('q')} AS w FROM {_WHOLE})")
def _(spark, d):
    return mcq(spark, d).select("question_id", F.array_sort(sim.word_grams(F.col("story"), lower=False, short="whole")).alias("g"))


_CH = "list_sort(list_distinct(list_transform(range(1, greatest(1, length({t}) - {k} + 1) + 1), lambda i: substr({t}, i, {k}))))"


@query("s_sim_04_mixed_grams", f"SELECT question_id, CASE WHEN len(w) >= 4 THEN {_grams('w')} WHEN length(q) >= 4 THEN {_CH.format(t='q', k=4)} ELSE list_sort(list_distinct(list_filter(string_split(q, ''), lambda c: c <> ''))) END AS g FROM (SELECT question_id, q, {_W.format('q')} AS w FROM (SELECT question_id, lower(q) AS q FROM {_WHOLE}))")
def _(spark, d):
    return mcq(spark, d).select("question_id", F.array_sort(sim.mixed_grams(F.col("story"))).alias("g"))


@query("s_sim_05_char_shingles", f"SELECT item_id, len(g) AS n, g[1] AS first FROM (SELECT item_id, {_CH.format(t='t', k=5)} AS g FROM (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark))")
def _(spark, d):
    g = F.array_sort(sim.char_shingles(F.col("text")))
    return table(spark, d, "benchmark").select("item_id", g.alias("g")).select("item_id", F.size("g").cast("long").alias("n"), F.get("g", F.lit(0)).alias("first"))


@query("s_sim_06_jaccard", f"SELECT doc_id, CASE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS j FROM (SELECT doc_id, w, list_distinct(w[1:len(w) // 2]) AS a, list_distinct(w[len(w) // 2 + 1:]) AS b FROM (SELECT doc_id, {_LOW} AS w FROM documents))")
def _(spark, d):
    """The words of a text's first half and of its second half."""
    w, half = F.col("w"), F.floor(F.size("w") / 2).cast("int")
    sets = documents(spark, d).select("doc_id", sim.words(F.lower("text")).alias("w")).select("doc_id", F.array_distinct(F.slice(w, F.lit(1), half)).alias("a"), F.array_distinct(F.slice(w, half + 1, F.size("w"))).alias("b"))
    return sets.select("doc_id", sim.jaccard(F.col("a"), F.col("b"), both_empty=1.0).alias("j"))


def _texts(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("key"), "text")


def _adaptive_grams(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("key"), sim.adaptive_grams(F.col("text")).alias("grams"))


def _adaptive(rows):
    return sim.gram_sets(rows, F.col("text"), "adaptive")


@query("s_sim_07_minhash")
def _(spark, d):
    """No oracle: hashes of this engine; a test holds the estimate against the exact similarity."""
    return sim.minhash(_adaptive_grams(spark, d)).withColumnRenamed("key", "doc_id")


def _signed(spark, d):
    """All documents as index, the labelled ones as queries."""
    index = cut(sim.minhash(_adaptive_grams(spark, d)))
    return index, index.join(table(spark, d, "labels").select(F.col("doc_id").alias("key")), "key", "left_semi")


@query("s_sim_08_lsh_candidates")
def _(spark, d):
    return sim.lsh_candidates(*_signed(spark, d), 0.5)


#: Sets of adaptive grams, and pairs (query, hit) of labelled and all documents with their Jaccard similarity.
_ADAPTIVE = f"(SELECT doc_id, list_distinct(g) AS g FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN {_grams('w', '1')} WHEN len(w) < 5 THEN {_grams('w', '3')} ELSE {_grams('w', '4')} END AS g FROM (SELECT doc_id, {_TOK} AS w FROM documents)))"
_NEAR = f"""WITH ag AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM {_ADAPTIVE}),
near AS (SELECT q.doc_id AS query, h.doc_id AS hit, count(*) / (any_value(q.n) + any_value(h.n) - count(*)) AS jaccard FROM ag q JOIN ag h ON q.x = h.x AND q.doc_id <> h.doc_id WHERE q.doc_id IN (SELECT doc_id FROM labels) GROUP BY q.doc_id, h.doc_id)"""


@query("s_sim_08_kept_index", f"{_NEAR} SELECT query, hit FROM near WHERE jaccard >= 0.9")
def _(spark, d):
    """Documents go into a kept index in two parts, one for each set of grams; its hits for the sets of labelled ones, of
    which those are kept that are similar to 0.9.  Such a pair is missed with a probability under 10^-14.  The documents of
    both sets are joined to it in the end."""
    import uuid

    from marlstone.operators.lsh_index import LshIndex
    from marlstone.plans.q_io import _place

    texts = _texts(spark, d)
    named = cut(_adaptive(texts).where(F.size("ids") > 0).select("key", F.xxhash64("ids").alias("h"), F.xxhash64(F.lit(1), "ids").alias("h2")))
    member = cut(named.join(named.groupBy("h", "h2").agg(F.min("key").alias("one")), ["h", "h2"]).select("key", "one"))
    asking = member.join(table(spark, d, "labels").select(F.col("doc_id").alias("key")), "key", "left_semi").withColumnRenamed("key", "query")
    index = cut(sim.minhash(_adaptive(texts.join(member.where("key = one"), "key", "left_semi"))))
    kept = LshIndex(spark, f"lsh_{uuid.uuid4().hex}", _place(spark), buckets=8)
    kept.insert(index.where("key % 2 = 0"))
    kept.insert(index)
    met = cut(kept.probe(index.join(asking.select(F.col("one").alias("key")), "key", "left_semi")).select(F.col("query").alias("a"), F.col("hit").alias("b")))
    kept.drop()
    needed = cut(met.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    near = sim.verified(met, cut(_adaptive(texts.join(needed, "key", "left_semi"))), 90, inclusive=True).select("a", "b")
    near = near.union(member.where("key = one").select(F.col("one").alias("a"), F.col("one").alias("b")))
    pairs = near.join(asking.withColumnRenamed("one", "a"), "a").join(member.select(F.col("one").alias("b"), F.col("key").alias("hit")), "b")
    return pairs.where("query <> hit").select("query", "hit")


@query("s_sim_09_estimated_jaccard")
def _(spark, d):
    """The first hit of each query with its estimated similarity, without an exact check."""
    c = sim.lsh_candidates(*_signed(spark, d), 0.5)
    return c.groupBy("query").agg(F.min(F.struct("hit", "estimate")).alias("b")).select("query", "b.*")


_LEAK = f"WITH {_PAIRS}, best AS (SELECT doc_id, max(s / (na + nb - s)) AS j, max(s / nb) AS c, min(item_id) FILTER (100 * s {{}} 60 * (na + nb - s)) AS hit FROM pair GROUP BY doc_id)"


@query("s_ddp_01_leakage_strict", _LEAK.format(">") + " SELECT doc_id, coalesce(j, 0) AS max_jaccard, hit IS NOT NULL AS leaked FROM documents LEFT JOIN best USING (doc_id)")
def _(spark, d):
    return dedup.leakage(_docs(spark, d), _items(spark, d), 60, inclusive=False).select(F.col("key").alias("doc_id"), "max_jaccard", "leaked")


@query("s_ddp_02_leakage_first_hit", _LEAK.format(">=").replace("60 *", "30 *") + " SELECT doc_id, hit AS first_hit FROM documents JOIN best USING (doc_id) WHERE hit IS NOT NULL")
def _(spark, d):
    """At a threshold of 0.3, which some of the driver's documents reach."""
    out = dedup.leakage(_docs(spark, d), _items(spark, d), 30)
    return out.where("leaked").select(F.col("key").alias("doc_id"), "first_hit")


@query("s_ddp_03_leakage_suspects", _LEAK.format(">=") + " SELECT doc_id, j AS max_jaccard FROM best ORDER BY j DESC, doc_id LIMIT 5")
def _(spark, d):
    out = dedup.leakage(_docs(spark, d), _items(spark, d))
    return out.where("max_jaccard > 0").orderBy(F.desc("max_jaccard"), "key").limit(5).select(F.col("key").alias("doc_id"), "max_jaccard")


@query("s_ddp_04_prefix_leaks", "SELECT item_id, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(d.text, left(b.text, 80)) GROUP BY item_id")
def _(spark, d):
    hits = dedup.prefix_leaks(documents(spark, d).select(F.col("doc_id").alias("key"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text"))
    return hits.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_docs"))


@query("s_ddp_05_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, d):
    return dedup.exact(documents(spark, d), F.col("text"), "doc_id").select("doc_id")


@query("s_ddp_06_conversation_dedup", "SELECT min(conv_id) AS conv_id FROM (SELECT conv_id, string_agg(role || '::' || text, '|||' ORDER BY turn) AS k FROM conversations GROUP BY conv_id) GROUP BY k")
def _(spark, d):
    from marlstone.functions.prompts import conversation_key

    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return dedup.exact(c, conversation_key(F.col("messages")), "conv_id").select("conv_id")


@query(
    "s_ddp_07_two_key_dedup",
    """WITH d AS (SELECT doc_id, source || ':' || n_chars AS k, text, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents), b AS (SELECT k, text FROM d WHERE old),
f AS (SELECT * FROM d WHERE NOT old AND k NOT IN (SELECT k FROM b) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1)
SELECT doc_id FROM f WHERE text NOT IN (SELECT text FROM b) QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def _(spark, d):
    """The whole table: labelled documents are the base, all others are new."""
    rows, labels = documents(spark, d).withColumn("k", F.concat("source", F.lit(":"), "n_chars")), table(spark, d, "labels")
    return dedup.two_key(rows.join(labels, "doc_id", "left_semi"), rows.join(labels, "doc_id", "left_anti"), "k", F.col("text"), "doc_id").select("doc_id")


#: The greedy pass as recursion over the rows in order, with the kept ones in a list.
_EDGES = f"""s AS (SELECT doc_id, g, len(g) AS n FROM {_SETS} WHERE len(g) > 0), x AS (SELECT doc_id, n, unnest(g) AS w FROM s),
e AS (SELECT a.doc_id AS late, b.doc_id AS early FROM x a JOIN x b ON a.w = b.w AND a.doc_id > b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) > 70 * (any_value(a.n) + any_value(b.n) - count(*))),
adj AS (SELECT late, list(early) AS near FROM e GROUP BY late), o AS (SELECT late, near, row_number() OVER (ORDER BY late) AS i FROM adj)"""


def _lower_sets(rows):
    return sim.gram_sets(rows, F.col("text"))


@query(
    "s_ddp_08_greedy_near_duplicates",
    f"""WITH RECURSIVE {_EDGES}, go(i, dropped) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.near, lambda y: NOT list_contains(go.dropped, y))) > 0 THEN list_append(go.dropped, o.late) ELSE go.dropped END FROM go JOIN o ON o.i = go.i + 1)
SELECT doc_id, list_contains(coalesce((SELECT dropped FROM go ORDER BY i DESC LIMIT 1), []), doc_id) AS dropped FROM documents""",
)
def _(spark, d):
    return dedup.near_duplicates(_texts(spark, d), 70, sets=_lower_sets).select(F.col("key").alias("doc_id"), F.col("near").isNotNull().alias("dropped"))


@query(
    "s_ddp_09_near_duplicates_of_corpus",
    f"""WITH RECURSIVE {_EDGES}, go(i, dropped) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN o.late >= 500 AND len(list_filter(o.near, lambda y: NOT list_contains(go.dropped, y))) > 0 THEN list_append(go.dropped, o.late) ELSE go.dropped END FROM go JOIN o ON o.i = go.i + 1)
SELECT doc_id, list_contains(coalesce((SELECT dropped FROM go ORDER BY i DESC LIMIT 1), []), doc_id) AS dropped FROM documents""",
)
def _(spark, d):
    """Ids below 500 are an existing corpus."""
    return dedup.near_duplicates(_texts(spark, d), 70, kept_before=500, sets=_lower_sets).select(F.col("key").alias("doc_id"), F.col("near").isNotNull().alias("dropped"))


_CASED = _EDGES.replace(_SETS, f"(SELECT doc_id, list_distinct(g) AS g FROM (SELECT doc_id, CASE WHEN len(w) < 4 AND t <> '' THEN [t] ELSE {_grams('w')} END AS g FROM (SELECT doc_id, coalesce(text, '') AS t, {_W.format("coalesce(text, '')")} AS w FROM documents)))")


@query(
    "s_ddp_10_fold_in",
    f"""WITH RECURSIVE {_CASED}, go(i, dropped) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN o.late >= 500 AND len(list_filter(o.near, lambda y: NOT list_contains(go.dropped, y))) > 0 THEN list_append(go.dropped, o.late) ELSE go.dropped END FROM go JOIN o ON o.i = go.i + 1)
SELECT doc_id FROM documents WHERE NOT list_contains(coalesce((SELECT dropped FROM go ORDER BY i DESC LIMIT 1), []), doc_id)""",
)
def _(spark, d):
    from marlstone.plans import pipelines

    rows = documents(spark, d).select(F.col("doc_id").alias("key"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text")
    return pipelines.fold_in(rows.where("key < 500"), rows.where("key >= 500"), items, F.col("text"))["rows"].select(F.col("key").alias("doc_id"))


@query("s_ddp_11_rollback", "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR lang <> 'en' GROUP BY text, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN doc_id END HAVING min(doc_id) IN (SELECT doc_id FROM labels) OR text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def _(spark, d):
    """The second version, with the English rows, is given up: the rows of other languages are merged anew into the first
    one, of labelled documents, and of those only texts that are new there."""
    import uuid

    from marlstone.sources import sinks

    cut(spark.range(1))
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/versions-{uuid.uuid4().hex}"
    rows, labels = documents(spark, d).select("doc_id", "lang", "text"), table(spark, d, "labels").select("doc_id")
    old, new = rows.join(labels, "doc_id", "left_semi"), rows.join(labels, "doc_id", "left_anti")
    first = sinks.versioned(old, root, "1")
    sinks.versioned(old.union(new.where("lang = 'en'")), root, "2")
    base = spark.read.parquet(first)
    fresh = dedup.exact(new.where("lang <> 'en'"), F.col("text"), "doc_id").join(base.select("text").distinct(), "text", "left_anti")
    return base.select("doc_id").unionByName(fresh.select("doc_id"))


@query("s_join_17_substring_join", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, left(b.text, 80))")
def _(spark, d):
    hits = dedup.prefix_leaks(documents(spark, d).select(F.col("doc_id").alias("key"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text"))
    return hits.select(F.col("item").alias("item_id"), F.col("key").alias("doc_id"))


@query("s_ddp_12_language_recheck", _LEAK.format(">").replace("60 *", "30 *") + " SELECT doc_id FROM documents LEFT JOIN best USING (doc_id) WHERE lang = 'es' AND hit IS NULL UNION ALL SELECT doc_id FROM documents WHERE lang <> 'es'")
def _(spark, d):
    """Rows of one language are checked again before they join the others."""
    docs = documents(spark, d)
    es = docs.where("lang = 'es'").select(F.col("doc_id").alias("key"), sim.word_grams(F.col("text")).alias("grams"))
    clean = dedup.leakage(es, _items(spark, d), 30, inclusive=False).where("NOT leaked").select(F.col("key").alias("doc_id"))
    return docs.where("lang <> 'es'").select("doc_id").unionByName(clean)


@query("s_ddp_13_last_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def _(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return dedup.last_by_key(e, ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id")


@query("s_ddp_14_duplicate_rate", "SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS extra, sum(c - 1) / sum(c) AS rate FROM (SELECT count(*) AS c FROM documents GROUP BY text)")
def _(spark, d):
    return dedup.duplicate_rate(documents(spark, d), F.col("text"))


@query(
    "s_ddp_15_max_jaccard_distribution",
    _LEAK.format(">") + ", v AS (SELECT lang, coalesce(j, 0) AS j FROM documents LEFT JOIN best USING (doc_id)) SELECT lang, count(*) AS n, avg(j) AS mean, max(j) AS max, list_sort(list(j))[1 + least(count(*) - 1, CAST(floor(95 * count(*) / 100) AS BIGINT))] AS p95 FROM v GROUP BY lang",
)
def _(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("key"), "lang", sim.word_grams(F.col("text")).alias("grams"))
    best = cut(dedup.leakage(docs, _items(spark, d)).join(docs.select("key", "lang"), "key"))
    return dedup.distribution(best, "lang", "max_jaccard")


@query("s_join_18_similarity_join", f"WITH {_PAIRS} SELECT doc_id, item_id, s / (na + nb - s) AS jaccard FROM pair WHERE 100 * s >= 20 * (na + nb - s)")
def _(spark, d):
    sets = [df.select("key", sim.gram_ids("grams").alias("ids")) for df in (_docs(spark, d), _items(spark, d))]
    return matches(*sets, 20).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "jaccard")
