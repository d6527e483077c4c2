"""Deduplication and decontamination in the order of the rows, which every operator takes as a column."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import text_hash
from marlstone.operators.best_match import best_matches
from marlstone.operators.greedy import settle
from marlstone.operators.lineage import cut
from marlstone.operators.similarity import rare_prefixes, sharing, sized, verified, with_ids


def first_by_key(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key (null is one); ties go to the row of least hash, equal rows are one.

    The first is found by pre-aggregated minima of order and hash.  Whole rows are shuffled once, to meet their hash in a
    table of the winners, and never sorted; only winners that repeat are told apart after that.
    """
    k, o, h, k2, o2, h2, n = (f"__{x}_{len(rows.columns)}" for x in ("key", "order", "hash", "own_key", "least", "own_hash", "n"))
    marked = rows.withColumns({k: key, o: order, h: F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))})
    same = marked.groupBy(k, o, h).agg(F.count("*").alias(n))
    least = same.groupBy(k).agg(F.min(F.struct(o, h, n)).alias("w"))
    own = least.select(F.col(k).alias(k2), F.col(f"w.{o}").alias(o2), F.col(f"w.{h}").alias(h2), F.col(f"w.{n}").alias(n))

    def met(winners: DataFrame) -> DataFrame:
        return marked.join(winners.hint("shuffle_hash"), F.col(k).eqNullSafe(F.col(k2)) & F.col(o).eqNullSafe(F.col(o2)) & (F.col(h) == F.col(h2)), "left_semi")

    once, again = met(own.where(F.col(n) == 1)), met(own.where(F.col(n) > 1)).dropDuplicates([k])
    return once.union(again).drop(k, o, h)


def exact(rows: DataFrame, text: Column, order: str) -> DataFrame:
    """The first row of each text, by a hash prefix."""
    return first_by_key(rows, text_hash(text), F.col(order))


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def two_key(base: DataFrame, new: DataFrame, key: str, text: Column, order: str) -> DataFrame:
    """New rows whose key and text hash have not been seen in base or in an earlier new row.

    A row that goes because of its text has still registered its key, and one that goes because of its key has not
    registered its text.
    """
    new = new.withColumn("__h", text_hash(text))
    seen = base.select(key).distinct()
    fresh = first_by_key(new.join(seen, key, "left_anti"), F.col(key), F.col(order))
    fresh = fresh.join(base.select(text_hash(text).alias("__h")).distinct(), "__h", "left_anti")
    return first_by_key(fresh, F.col("__h"), F.col(order)).drop("__h")


def leakage(train: DataFrame, evaluation: DataFrame, percent: int = 60, inclusive: bool = True) -> DataFrame:
    """train, evaluation: (key, grams or ids).  Per training key: max_jaccard, max_containment, leaked, first_hit.

    first_hit is the least evaluation key at which the threshold is met; keys of several sets sort by set, then row.
    Rows that share nothing have 0.  See best_match: training rows are searched where they are.
    """
    best = best_matches(with_ids(train), with_ids(evaluation), percent, inclusive)
    return best.select("key", "max_jaccard", "max_containment", F.col("first_hit").isNotNull().alias("leaked"), "first_hit")


#: How many times more rows of a gram are compared with the rest of it in each round.
GROWTH = 8


def near_duplicates(rows: DataFrame, percent: int = 70, kept_before: int | None = None, sets=with_ids, among: DataFrame | None = None) -> DataFrame:
    """rows: (key, grams) in key order.  (key, near): near is null for rows that stay, else a kept row that it is near to.

    sets: makes (key, ids) of rows that have something else, as texts, which are smaller to shuffle than their sets.
    among: the keys that take part, of which a result is given; else all.

    Sets that don't share as much of their elements as a near row must are found first (``sharing``), from small parts of
    the elements, and stay; only the others' sets are shuffled whole and kept.  The result is that of a pass in key order that drops a row near an earlier kept one.  Rows with equal sets can only
    stay first.  The others are decided in rounds over the rare grams by which near rows meet.  A round compares the first
    rows of each gram, one at first and ``GROWTH`` times as many in the next, with the rest of it; rows that are among the
    first of all their grams have all their earlier neighbours then, and greedy.settle decides what hangs together.  So
    near copies of one text make a pair each and not one with each other, and the number of rounds grows with the
    logarithm of the longest list of rows that share a gram and are not near.  Keys below kept_before are an existing
    corpus and stay in any case; new rows are compared with those that share a rare gram.
    """
    shared = sharing(sets(rows), percent)
    shared = shared if among is None else shared.join(among.select("key"), "key", "left_semi")
    keyed = cut(sets(rows.join(shared, "key", "left_semi")).withColumn("h", F.md5(F.array_join(F.array_sort("ids").cast("array<string>"), ","))))
    old = F.lit(False) if kept_before is None else F.col("key") < kept_before
    first = cut(keyed.groupBy("h").agg(F.min("key").alias("first")))
    one = cut(keyed.join(first.drop("h"), F.col("key") == F.col("first"), "left_semi").where(F.size("ids") > 0).select("key", "ids"))
    open_ = cut(rare_prefixes(one, percent))
    gone = rows.sparkSession.createDataFrame([], "key long, near long")
    if kept_before is not None:
        a, b = (open_.where(old if x == "b" else ~old).select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), "g") for x in "ab")
        near = verified(a.join(b, "g").where(sized("n_a", "n_b", percent)).select("a", "b").distinct(), one, percent)
        gone = cut(near.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")))
        open_ = cut(open_.where(~old).join(gone, "key", "left_anti"))
    ahead = 1
    while open_.take(1):
        place = F.row_number().over(Window.partitionBy("g").orderBy("key"))
        heads = cut(open_.withColumn("place", place).where(F.col("place") <= ahead))  # tasks pass on as many of a gram at most
        firsts = heads.groupBy("key").agg(F.count("*").alias("n_first"))
        nodes = cut(open_.groupBy("key").agg(F.count("*").alias("n_grams")).join(firsts, "key", "left").select("key", (F.col("n_grams") == F.coalesce("n_first", F.lit(0))).alias("complete")))
        early = heads.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "g")
        pairs = open_.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "g").join(early, "g").where((F.col("a") > F.col("b")) & sized("n_a", "n_b", percent)).select("a", "b").distinct()
        edges = cut(verified(pairs, one, percent).select(F.col("a").alias("late"), F.col("b").alias("early")))
        settled = cut(settle(nodes, edges))
        stays = settled.where("stays").select(F.col("key").alias("early"))
        more = cut(edges.join(stays, "early", "left_semi").groupBy(F.col("late").alias("key")).agg(F.min("early").alias("near")))
        gone = gone.union(more)
        open_ = cut(open_.join(settled.select("key"), "key", "left_anti"))
        ahead *= GROWTH
    copies = keyed.join(first, "h").where((F.col("key") != F.col("first")) & (F.size("ids") > 0) & ~old)
    copies = copies.join(gone.withColumnRenamed("key", "first"), "first", "left").select("key", F.coalesce("near", "first").alias("near"))
    return (rows if among is None else among).select("key").join(gone.union(copies), "key", "left")


#: Characters of the prefixes in one automaton, about 40 bytes each; more prefixes are searched by several.
AUTOMATON_CHARS = 2_000_000


def _prefix_hits(prefixes):
    """(key, text) to (key, prefix) for each prefix that stands in the text."""

    def run(batches):
        import ahocorasick

        search = ahocorasick.Automaton()
        for i, p in enumerate(prefixes.value):
            search.add_word(p, i)
        search.make_automaton()
        for batch in batches:
            found = [sorted({i for _, i in search.iter(t)}) if t else [] for t in batch.column(1).to_pylist()]
            row = pa.array([r for r, hits in enumerate(found) for _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([prefixes.value[i] for hits in found for i in hits], pa.string())], names=["key", "prefix"])

    return run


def prefix_leaks(train: DataFrame, evaluation: DataFrame, n: int = 80) -> DataFrame:
    """train (key, text), evaluation (key, text): evaluation keys whose first n characters stand in a training text.

    Counted, not dropped.  An Aho-Corasick automaton of all prefixes runs once over each training text where it is read;
    only hits are shuffled.  Prefixes of more than AUTOMATON_CHARS characters make several automata, and as many runs.
    Empty prefixes match nothing.
    """
    e = evaluation.select(F.col("key").alias("item"), F.left("text", F.lit(n)).alias("prefix")).where(F.length("prefix") > 0)
    distinct = cut(e.select("prefix").distinct())
    blocks = distinct.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // AUTOMATON_CHARS + 1
    kind, hits = train.schema["key"].dataType.simpleString(), []
    for b in range(blocks):
        some = [r[0] for r in distinct.where(F.pmod(F.xxhash64("prefix"), F.lit(blocks)) == b).collect()]  # AUTOMATON_CHARS of them, about
        if some:
            hits.append(train.select("key", "text").mapInArrow(_prefix_hits(train.sparkSession.sparkContext.broadcast(some)), f"key {kind}, prefix string"))
    if not hits:
        return train.sparkSession.createDataFrame([], f"item {e.schema['item'].dataType.simpleString()}, key {kind}")
    return reduce(DataFrame.union, hits).join(e, "prefix").select("item", "key").distinct()


def duplicate_rate(rows: DataFrame, text: Column) -> DataFrame:
    """Rows, extra copies, and their share."""
    n = rows.groupBy(text_hash(text)).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("extra"))
    return n.withColumn("rate", F.coalesce(F.try_divide("extra", "n"), F.lit(0.0)))


def distribution(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, max and p95 (the value at rank int(.95 n), from 0) of each group."""
    from marlstone.operators.aggregates import nearest_rank

    base = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return base.join(nearest_rank(rows, [group], value, [95], rule="n"), group)
