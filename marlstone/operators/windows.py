"""Rules over the last and best values of metric series (run, step, tag, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_values(series: DataFrame, n: int) -> DataFrame:
    """The last n values of each series in step order, as ``last``.

    Spark keeps only a group's first rows while it ranks them (WindowGroupLimit), before the shuffle too.
    """
    w = Window.partitionBy("run", "tag").orderBy(F.desc("step"))
    top = series.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return top.groupBy("run", "tag").agg(F.collect_list("value").alias("last"))


def all_above(n: int, limit: float, last: str = "last") -> Column:
    """Whether there are n last values, all over the limit."""
    return (F.size(last) == n) & (F.array_min(last) > limit)


def all_below(n: int, limit: float | Column, last: str = "last") -> Column:
    return (F.size(last) == n) & (F.array_max(last) < limit)


def below_best(series: DataFrame, n: int, margin: float) -> DataFrame:
    """Whether the last n values are all under the best of all by more than the margin."""
    best = series.groupBy("run", "tag").agg(F.max("value").alias("best"))
    return last_values(series, n).join(best, ["run", "tag"]).select("run", "tag", all_below(n, F.col("best") - margin).alias("degraded"))


def best_step(series: DataFrame) -> DataFrame:
    """Step and value of each series' maximum, the first on ties."""
    m = series.groupBy("run", "tag").agg(F.min(F.struct((-F.col("value")).alias("neg"), "step", "value")).alias("b"))
    return m.select("run", "tag", "b.step", "b.value")


def best_and_final(series: DataFrame) -> DataFrame:
    """Final and best value, and how far the final is behind, in percentage points."""
    m = series.groupBy("run", "tag").agg(F.max_by("value", "step").alias("final"), F.max("value").alias("best"))
    return m.withColumn("delta_pp", (F.col("best") - F.col("final")) * 100)
