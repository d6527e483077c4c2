"""Joins of result tables: paired models, contingency, error classes, resumption and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(ours: DataFrame, reference: DataFrame, keys: list[str], missing: str = "skip") -> DataFrame:
    """Our rows with the reference's ref_correct and ref_pred.  A missing partner is skipped, wrong, or null.

    With null, ref_wrong is true for a missing partner, since what isn't known to be right counts as wrong there.
    """
    ref = reference.select(*keys, F.col("correct").alias("ref_correct"), F.col("pred").alias("ref_pred"))
    out = ours.join(ref, keys, "inner" if missing == "skip" else "left")
    if missing == "wrong":
        out = out.withColumn("ref_correct", F.coalesce("ref_correct", F.lit(False)))
    return out.withColumn("ref_wrong", ~F.coalesce("ref_correct", F.lit(False)))


def joined_all(metadata: DataFrame, results: dict[str, DataFrame], key: str = "question_id") -> DataFrame:
    """Metadata with one correct column per result set; a key that any of them lacks raises an error."""
    out = metadata
    for name, r in results.items():
        out = out.join(r.select(key, F.col("correct").alias(name)), key, "left")
        out = out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit(f"{name} lacks "), F.col(key)))).otherwise(F.col(name)))
    return out


def contingency(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both right, only the reference, only ours, both wrong; per key and, with null keys, overall."""
    a, b = F.col("correct"), F.col("ref_correct")
    counts = [F.count_if(a & b).alias("both_right"), F.count_if(~a & b).alias("only_ref"), F.count_if(a & ~b).alias("only_ours"), F.count_if(~a & ~b).alias("both_wrong"), F.count("*").alias("n")]
    return pairs.groupingSets([keys, []], *keys).agg(*counts)


def error_classes(base: DataFrame, a: DataFrame, b: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows that base has wrong, as all_wrong, only_a, only_b or both_right (hot); a missing partner is wrong."""
    out = base.where("NOT correct")
    for name, r in (("a", a), ("b", b)):
        out = out.join(r.select(key, F.col("correct").alias(f"{name}_right")), key, "left").withColumn(f"{name}_right", F.coalesce(f"{name}_right", F.lit(False)))
    kind = F.when(F.col("a_right") & F.col("b_right"), "both_right").when(F.col("a_right"), "only_a").when(F.col("b_right"), "only_b").otherwise("all_wrong")
    return out.withColumn("kind", kind)


def changes(before: DataFrame, after: DataFrame, key: str, group: str) -> DataFrame:
    """Regressions, improvements and their difference per group."""
    pairs = before.select(key, group, F.col("correct").alias("was")).join(after.select(key, F.col("correct").alias("now")), key)
    out = pairs.groupBy(group).agg(F.count_if(F.col("was") & ~F.col("now")).alias("regressions"), F.count_if(~F.col("was") & F.col("now")).alias("improvements"))
    return out.withColumn("net", F.col("improvements") - F.col("regressions"))


def closeable_gap(pairs: DataFrame, group: str) -> DataFrame:
    """One row: the gap to the reference that groups behind it could close, weighted by their size."""
    g = pairs.groupBy(group).agg(F.count("*").alias("n"), (F.avg(F.col("ref_correct").cast("double")) - F.avg(F.col("correct").cast("double"))).alias("gap"))
    return g.agg((F.sum(F.greatest("gap", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("upside"))


def restrict(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_semi")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys), keys, "left_anti")


def error_rows(rows: DataFrame, results: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Rows that at least so many results have wrong."""
    wrong = results.where("NOT correct").groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(wrong, key, "left_semi")


def fan_out(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Each row once for each value, by expansion and not by a join."""
    return rows.withColumn(column, F.explode(F.array(*map(F.lit, values))))


def fallback(new: DataFrame, old: DataFrame, cell: list[str]) -> DataFrame:
    """All rows of new, and those of old whose whole cell new lacks, with their provenance."""
    rest = old.join(new.select(*cell).distinct(), cell, "left_anti")
    return new.withColumn("provenance", F.lit("new")).unionByName(rest.withColumn("provenance", F.lit("fallback")))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How often two prediction sets agree, null with null included."""
    pairs = a.select(*keys, F.col("pred").alias("p")).join(b.select(*keys, F.col("pred").alias("q")), keys)
    return pairs.agg(F.count("*").alias("n"), F.avg(F.col("p").eqNullSafe(F.col("q")).cast("double")).alias("agreement"))


def update(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both tables' keys; right's value where it has one."""
    r = right.select(*keys, F.col(value).alias("__v"))
    return left.select(*keys, value).join(r, keys, "full_outer").select(*keys, F.coalesce("__v", value).alias(value))


def union_ordered(tables: list[DataFrame], ordinal: str = "source_ord") -> DataFrame:
    """All rows with the position of their table."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn(ordinal, F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def key_difference(declared: DataFrame, used: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Names used but not declared, without the allowed ones."""
    return used.select("name").distinct().exceptAll(declared.select("name").distinct()).where(~F.col("name").isin(*allowed) if allowed else F.lit(True))
