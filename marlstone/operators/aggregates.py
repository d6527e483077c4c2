"""Aggregates: accuracy cubes, frequency tables, confusion matrices, percentiles and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.lineage import cut


def accuracy(correct: Column) -> Column:
    """Share of correct rows; 0 for an empty slice."""
    return F.coalesce(F.avg(correct.cast("double")), F.lit(0.0))


def accuracy_cube(rows: DataFrame) -> DataFrame:
    """Per model and protocol: n, overall, one rate per language, and a map of rates by task.

    A null language or task is ``?`` in the maps; a null model or protocol is a group of its own.
    """
    langs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "acc"))))
    tasks = F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", "acc"))))
    keys = ["model", "protocol"]
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), accuracy(F.col("correct")).alias("overall"))
    by = lambda c, m: rows.groupBy(*keys, F.coalesce(c, F.lit("?")).alias(c)).agg(accuracy(F.col("correct")).alias("acc")).groupBy(*(F.col(k).alias(f"{k}_{c}") for k in keys)).agg(m.alias(f"by_{c}"))
    for c, m in (("language", langs), ("task", tasks)):
        base = base.join(by(c, m), [F.col(k).eqNullSafe(F.col(f"{k}_{c}")) for k in keys]).drop(*(f"{k}_{c}" for k in keys))
    return base


def frequency(rows: DataFrame, column: str, missing: str = "?") -> DataFrame:
    """Value, count and share; null as a value of its own."""
    n = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))
    return n.select("value", "n", (F.col("n") / n.agg(F.sum("n")).scalar()).alias("share"))


def share_by(rows: DataFrame, group: str, column: str) -> DataFrame:
    """Counts and shares of a column's values per group, and over all groups (null group, overall is true).

    Rows whose group is null are a group of their own, with overall false.
    """
    n = rows.groupBy(group, column).agg(F.count("*").alias("n")).withColumn("overall", F.lit(False))
    every = n.groupBy(column).agg(F.sum("n").alias("n")).select(F.lit(None).cast(n.schema[group].dataType).alias(group), column, "n", F.lit(True).alias("overall"))
    n = n.union(every)
    return n.select(group, column, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(group, "overall"))).alias("share"), "overall")


def cell(rows: DataFrame, keys: list[str], pivot: str, values: list[str]) -> DataFrame:
    """Accuracy and counts as text, one column per value; a dash where there are no rows."""
    text = lambda v: F.when(F.count_if(F.col(pivot) == v) == 0, "—").otherwise(F.format_string("%.4f (%d/%d)", F.count_if((F.col(pivot) == v) & F.col("correct")) / F.greatest(F.count_if(F.col(pivot) == v), F.lit(1)), F.count_if((F.col(pivot) == v) & F.col("correct")), F.count_if(F.col(pivot) == v)))
    return rows.groupBy(*keys).agg(*(text(v).alias(v) for v in values))


def pivot_accuracy(rows: DataFrame, keys: list[str], pivot: str, values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.avg(F.when(F.col(pivot) == v, F.col("correct").cast("double"))).alias(v) for v in values))


def best_protocol(rows: DataFrame, order: list[str], keys: tuple[str, ...] = ("model", "benchmark")) -> DataFrame:
    """Each key's protocol of highest accuracy, ties by the given order."""
    acc = rows.groupBy(*keys, "protocol").agg(F.avg(F.col("correct").cast("double")).alias("acc"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("protocol"))
    best = acc.groupBy(*keys).agg(F.min(F.struct((-F.col("acc")).alias("neg"), rank.alias("rank"), "protocol")).alias("b"))
    return best.select(*keys, F.col("b.protocol").alias("protocol"), (-F.col("b.neg")).alias("acc"))


def best_mean(best: DataFrame, complete: int | None = None) -> DataFrame:
    """Mean over benchmarks per model; with complete, null unless so many are there."""
    mean = F.avg("acc") if complete is None else F.when(F.count("*") == complete, F.avg("acc"))
    return best.groupBy("model").agg(F.count("*").alias("n"), mean.alias("mean"))


def winner(means: DataFrame, reference: str) -> DataFrame:
    """The model of highest mean apart from the reference; null means are out, ties go to the least name."""
    one = means.where((F.col("model") != reference) & F.col("mean").isNotNull())
    return one.agg(F.min(F.struct((-F.col("mean")).alias("neg"), "model")).alias("b")).select(F.col("b.model").alias("model"), (-F.col("b.neg")).alias("mean"))


def judge_sweep(mean: Column, anchor: Column, floor: Column, least: float) -> Column:
    """A verdict from whether the mean beats the anchor's and the floor metric holds."""
    better, holds = mean > anchor, floor >= least
    return F.when(better & holds, "adopt").when(better, "better mean, floor broken").when(holds, "floor holds, no gain").otherwise("reject")


def delta(rows: DataFrame, before: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Difference to an earlier version in percentage points; null where that lacks the cell."""
    old = before.select(*keys, F.col(value).alias("__old"))
    return rows.join(old, keys, "left").select(*keys, value, ((F.col(value) - F.col("__old")) * 100).alias("delta_pp"))


def near_reference(means: DataFrame, reference: str, eps: float = 0.02) -> DataFrame:
    """Distance of every model to the reference, and whether it is within eps."""
    distance = means.where(F.col("model") == reference).select("mean").scalar() - F.col("mean")
    return means.select("model", "mean", distance.alias("distance"), (distance <= eps).alias("near"))


#: Bins into which the range of a wanted rank is divided in each pass.
BINS = 4096


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percents: list[int], rule: str = "min", bins: int = BINS) -> DataFrame:
    """Percentiles that are members of the sorted values, at rank (from 0) int(q/100 n), int(q/100 (n-1)), or the first of
    these but at most n - 1.  Exact; nulls have no rank, NaN is the largest value.

    A group is never sorted.  In each pass the range in which a rank must lie is divided into bins; the bin that the rank
    falls into gives the next range, from its least to its largest value, until these are one.
    """
    at = {"min": "least(n - 1, CAST(floor({q} * n / 100) AS BIGINT))", "n": "least(n - 1, CAST(floor({q} * n / 100) AS BIGINT))", "n-1": "CAST(floor({q} * (n - 1) / 100) AS BIGINT)"}[rule]
    ks = [f"__k{i}" for i in range(len(keys))]
    v = F.col(value)
    counts = cut(rows.where(v.isNotNull()).groupBy(*[F.col(k).alias(x) for k, x in zip(keys, ks, strict=True)], v.alias("v")).agg(F.count("*").alias("c")))
    whole = counts.groupBy(*ks).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = whole.select(*ks, "lo", "hi", F.inline(F.array(*(F.struct(F.lit(q).alias("q"), F.expr(at.format(q=q)).alias("at")) for q in percents))))
    state = cut(state)
    place = F.nanvl((F.col("v").cast("double") / 2 - F.col("lo").cast("double") / 2) / (F.col("hi").cast("double") / 2 - F.col("lo").cast("double") / 2), F.lit(0.5))
    bin_ = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins - 1), F.floor(place * bins).cast("int"))))
    while state.where("lo < hi").take(1):
        open_ = state.where("lo < hi").select(*[F.col(k).alias(f"s{k}") for k in ks], "lo", "hi", "q", "at")
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"s{k}")) for k in ks), F.lit(True))
        met = counts.join(open_, same & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        binned = met.groupBy(*ks, "q", "at", bin_.alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*ks, "q").orderBy("bin"))  # over bins
        there = binned.withColumn("upto", upto).where("upto > at AND upto - c <= at")
        state = cut(state.where("NOT lo < hi").unionByName(there.select(*ks, F.col("low").alias("lo"), F.col("high").alias("hi"), "q", (F.col("at") - F.col("upto") + F.col("c")).alias("at"))))
    found = [F.min(F.when(F.col("q") == q, F.col("lo"))).alias(f"p{q}") for q in percents]
    return state.groupBy(*[F.col(x).alias(k) for k, x in zip(keys, ks, strict=True)]).agg(*found)


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in (low, high] bins with the cumulative share; values outside of all bins count in the total only."""
    bins = [F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.count_if((F.col(value) > a) & (F.col(value) <= b)).alias("n")) for a, b in zip(edges, edges[1:], strict=False)]
    one = rows.agg(F.array(*bins).alias("bins"), F.count(value).alias("total"))
    out = one.select("total", F.inline("bins"))
    w = Window.partitionBy("total").orderBy("low")
    return out.select("low", "high", "n", F.coalesce(F.try_divide(F.sum("n").over(w), "total"), F.lit(0.0)).alias("cumulative"))


def zero_histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Bins of which the first holds exact zeros; what no bin covers is reported as such."""
    label = F.when(F.col(value) == 0, "0").otherwise("uncovered")
    for a, b in zip(edges, edges[1:], strict=False):
        label = F.when((F.col(value) > a) & (F.col(value) <= b), f"({a:g}, {b:g}]").otherwise(label)
    return rows.groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, letters: str = "ABCD", errors_only: bool = True) -> DataFrame:
    """Gold by predicted letter; other predictions, null among them, are ``invalid``."""
    rows = rows.where("NOT correct") if errors_only else rows
    pred = F.when(F.col("pred").isin(*letters), F.col("pred")).otherwise("invalid")
    return rows.groupBy("gold").agg(*(F.count_if(pred == x).alias(x) for x in [*letters, "invalid"]))


def collapse_warning(rows: DataFrame, column: str, limit: float = 0.5, least: int = 50) -> DataFrame:
    """The most frequent value, its share, and whether that is suspicious; ties go to the least value."""
    f = frequency(rows, column)
    return f.agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("neg"), "value", "share")).alias("b")).select("n", "b.value", "b.share", ((F.col("n") >= least) & (F.col("b.share") > limit)).alias("warn"))


def outcome_rates(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Counts of ok, bad and failed rows, and the share of ok among those that did not fail."""
    c = [F.count_if(F.col(outcome) == x).alias(x) for x in ("ok", "bad", "failed")]
    return rows.agg(*c).withColumn("good_rate", F.coalesce(F.try_divide("ok", F.col("ok") + F.col("bad")), F.lit(0.0)))
