"""Sinks: JSON lines, versions instead of overwriting, small JSON and Markdown reports, and integrity manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.json_stream import JsonElements

#: Reports are read by people; a table of more rows is an error, not a longer report.
REPORT_ROWS = 10_000


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def json_arrays(df: DataFrame, path: str) -> None:
    """A file for each task, each one array of the rows as objects; a task holds one row at a time."""
    df.sparkSession.dataSource.register(JsonElements)
    every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    nulls = [F.lit(None).cast(t).alias(n) for n, t in (("file", "string"), ("path", "array<string>"), ("i", "bigint"))]
    df.select(*nulls, every.alias("value")).write.format("json_elements").mode("append").save(path)


def versioned(df: DataFrame, root: str, version: str) -> str:
    """A new version's folder; one that exists is an error, so an input that is being read is never overwritten."""
    path = f"{root}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def report_rows(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has {REPORT_ROWS} rows at most; aggregate first")
    return [r.asDict(recursive=True) for r in rows]


def json_report(df: DataFrame) -> str:
    """A small table as a JSON array."""
    return json.dumps(report_rows(df), ensure_ascii=False, indent=2, default=str)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small table as Markdown; numbers with a fraction are rounded, null is a dash."""
    def cell(x) -> str:
        return "—" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|")

    rows = report_rows(df)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows)])


def data_card(df: DataFrame, title: str, columns: tuple[str, ...], top: int = 50) -> str:
    """Markdown with the number of rows and a frequency table for each column; values beyond the top most frequent ones
    are counted together in a last line."""
    from marlstone.operators.aggregates import frequency

    parts = [f"# {title}", f"Rows: {df.count()}"]
    for c in columns:
        every = frequency(df, c)
        head = every.orderBy(F.desc("n"), "value").limit(top)
        rest = every.join(head.select("value"), "value", "left_anti").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("share").alias("share")).where("k > 0")
        other = rest.select(F.concat(F.lit("other ("), F.col("k").cast("string"), F.lit(" values)")).alias("value"), "n", "share")
        parts += [f"## {c}", markdown(head.unionByName(other).orderBy(F.col("value").startswith("other ("), F.desc("n"), "value"))]
    return "\n\n".join(parts)


def audit(df: DataFrame, group: str) -> DataFrame:
    """One row: total, and counts per value of a column as a map."""
    by = df.groupBy(F.coalesce(F.col(group), F.lit("?")).alias("k")).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("dist"))


def manifest(spark: SparkSession, glob: str) -> DataFrame:
    """Name, size and SHA-256 of every file that the pattern finds."""
    return spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Names that are missing, extra or changed against an expected manifest."""
    j = found.select("name", "sha256").join(expected.select("name", F.col("sha256").alias("want")), "name", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("sha256") != F.col("want"), "changed")
    return j.select("name", state.alias("state")).where("state IS NOT NULL")


def tidy_series(series: DataFrame) -> DataFrame:
    """The long table that a plot of several panels would be drawn from."""
    return series.select("tag", "run", "step", "value").orderBy("tag", "run", "step")


def best_pointer(series: DataFrame, path: str) -> None:
    """Writes the best step of each run, which readers follow instead of a link."""
    from marlstone.operators.windows import best_step

    best_step(series).write.mode("overwrite").parquet(path)
