"""Filters, and reports of what they drop and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_report(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows per reason, the first that holds; ``kept`` where none does."""
    why = F.lit("kept")
    for name, c in reversed(reasons.items()):
        why = F.when(F.coalesce(c, F.lit(False)), name).otherwise(why)
    return rows.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def deny(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def allow_keys(rows: DataFrame, keys: DataFrame, key: str = "question_id") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def length_window(rows: DataFrame, column: str, low: int, high: int, needed: tuple[str, ...] = ()) -> DataFrame:
    ok = reduce(lambda a, b: a & b, [F.trim(F.coalesce(c, F.lit(""))) != "" for c in needed], F.length(column).between(low, high))
    return rows.where(ok)


def number_in_range(value: Column, low: float, high: float) -> Column:
    """Whether a text is a number in the range and not negative; what can't be read counts as -1."""
    x = F.coalesce(value.try_cast("double"), F.lit(-1.0))
    return (x >= 0) & (x <= high) & (x >= low)


def trusted(assessment: Column, confidence: Column) -> Column:
    """Verdicts that a label is right with some confidence; missing ones count as wrong and low."""
    return (F.coalesce(assessment, F.lit("wrong")) == "correct") & F.coalesce(confidence, F.lit("low")).isin("high", "medium")


def mastery(rows: DataFrame, labels: DataFrame, key: str, limit: float = 0.95) -> DataFrame:
    """Rows with a label whose mean reward is below the limit."""
    return rows.join(labels.select(key, "reward_mean"), key).where(F.col("reward_mean") < limit)


def difficulty_windows(groups: DataFrame, mean: str, windows: list[tuple[float, float]]) -> DataFrame:
    """How many groups have a mean strictly inside each window."""
    found = groups.select(F.explode(F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), ((F.col(mean) > a) & (F.col(mean) < b)).cast("int").alias("inside")) for a, b in windows))).alias("w"))
    return found.groupBy("w.low", "w.high").agg(F.sum("w.inside").alias("n_inside"), F.count("*").alias("n"))


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the input order, which must be given."""
    return rows.orderBy(*order).limit(n)


def route(rows: DataFrame, domains: DataFrame, other: str = "other") -> DataFrame:
    """Rows with the domain of their tag; unmapped tags go to another domain and are flagged, not lost."""
    out = rows.join(domains.select("tag", "domain"), "tag", "left")
    return out.withColumn("unmapped", F.col("domain").isNull()).withColumn("domain", F.coalesce("domain", F.lit(other)))


def assertions(rows: DataFrame, checks: dict[str, tuple[Column, str, float]]) -> DataFrame:
    """One row per check with the aggregate's value, and whether it is at least or at most the limit."""
    one = rows.agg(*(c.cast("double").alias(k) for k, (c, _, _) in checks.items()))
    parts = [F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), (F.col(k) >= v if op == ">=" else F.col(k) <= v).alias("passed")) for k, (_, op, v) in checks.items()]
    return one.select(F.explode(F.array(*parts)).alias("c")).select("c.*")
