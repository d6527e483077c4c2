"""Scans of JSON lines, JSON arrays, CSV, Parquet and logs, all with given schemas, plus file discovery through Spark."""

from __future__ import annotations

import codecs
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.lineage import cut
from marlstone.sources.json_stream import JsonElements, open_path


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """file, path, i, value: the elements of all outermost arrays of JSON files, see json_stream."""
    spark.dataSource.register(JsonElements)
    return spark.read.format("json_elements").load(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one array of objects each, of any length; a file that is something else is an error."""
    whole = F.when(F.size("path") == 0, F.from_json("value", schema, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.lit("the file is no array")))
    return elements(spark, path).select(whole.alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated with a header and quoted line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system it belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def or_empty(spark: SparkSession, path: str, schema: str, read: Callable[..., DataFrame] = jsonl) -> DataFrame:
    """The file's rows, or none if it is missing."""
    return read(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def first_of(*sources: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The first source that gives a table with rows; one that can't be read counts as none."""
    for s in sources:
        try:
            df = s()
        except AnalysisException:
            continue
        if df is not None and df.take(1):
            return df
    return None


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows of a file in any of three forms: an array, ``{protocol: {"records": [...]}}``, or
    ``{"results": {protocol: [...]}}``; protocol is added where the form has it."""
    at = F.col("path")
    one, two = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    listed, recorded = (F.size(at) == 2) & (one == "results"), (F.size(at) == 2) & (two == "records") & (one != "results")
    rows = elements(spark, path).where((F.size(at) == 0) | listed | recorded)
    return rows.select(F.when(listed, two).when(recorded, one).alias("protocol"), F.from_json("value", schema).alias("r")).select("protocol", "r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with their number from 0.

    A task reads one block of the file from its start on, so a line's number is its rank in the block plus the lines of
    all blocks before; ids that rise within a task give the rank, and nothing is sorted in one place.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("id"))
    lines = cut(lines)
    moved, total = [], 0
    for r in sorted(lines.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()):  # one row a block
        moved.append((r.block, total - r["first"]))
        total += r.n
    by_block = F.broadcast(spark.createDataFrame(moved, "block long, moved long"))
    return lines.join(by_block, "block").select((F.col("id") + F.col("moved")).alias("line"), "value")


def zipped(spark: SparkSession, rows_path: str, labels_path: str, schema: str) -> DataFrame:
    """Objects of one file with the label lines of another by position; different lengths are an error."""
    a, b = numbered_lines(spark, rows_path), numbered_lines(spark, labels_path)
    joined = a.join(b.withColumnRenamed("value", "label"), "line", "full_outer")
    check = F.when(F.col("value").isNull() | F.col("label").isNull(), F.raise_error(F.lit("rows and labels differ in number"))).otherwise(F.col("label"))
    return joined.select("line", F.from_json("value", schema).alias("r"), F.trim(check).alias("label")).select("line", "r.*", "label")


def log_series(lines: DataFrame, tags: list[str] | None = None, column: str = "value") -> DataFrame:
    """(step, tag, value) of the payloads ``{"step": n, "metrics": {...}}`` inside log lines; other lines are skipped."""
    payload = F.from_json(F.regexp_extract(column, r"(\{.*\"metrics\".*\})", 1), "step bigint, metrics map<string, double>")
    out = lines.select(payload.alias("p")).where("p.step IS NOT NULL").select("p.step", F.explode("p.metrics").alias("tag", "value"))
    return out.where(F.col("tag").isin(*tags)) if tags else out


def matches_of(blocks: Iterable[str], pattern: str, longest: int) -> Iterator[str]:
    """The one group of each match in a text that comes in blocks; two windows of the longest match are held."""
    search, held, more = re.compile(pattern), "", True
    blocks = iter(blocks)
    while more:
        block = next(blocks, None)
        more = block is not None
        held += block or ""
        if more and len(held) < 2 * longest:
            continue
        at = 0
        for m in search.finditer(held):
            if more and m.start() > len(held) - longest:  # it may go on in what is not read yet
                break
            yield m[1]
            at = m.end()
        held = held[max(at, len(held) - longest) :]


def log_matches(spark: SparkSession, path: str, pattern: str, longest: int = 1 << 20) -> DataFrame:
    """file, i, match: every match of a pattern with one group over the whole text of each file, in order.

    A file is read as a stream by one task, which holds two windows of longest characters; a match may span lines but has
    longest characters at most.  The pattern is one of Python's re.
    """
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, at = open_path(uri)
                with files.open_input_stream(at) as stream:
                    decode = codecs.getincrementaldecoder("utf-8")("replace")
                    held = []
                    for i, m in enumerate(matches_of((decode.decode(b) for b in iter(lambda: stream.read(1 << 20), b"")), pattern, longest)):
                        held.append((uri, i, m))
                        if len(held) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["file", "i", "match"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["file", "i", "match"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "file string, i bigint, match string")


def newest(spark: SparkSession, glob: str) -> DataFrame:
    """Path and time of the newest file that the pattern finds."""
    files = spark.read.format("binaryFile").load(glob).select("path", "modificationTime")
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("f")).select("f.path", "f.modificationTime")


def scalars(series: DataFrame, tag: str) -> DataFrame:
    """One tag's steps and values; none if it doesn't occur."""
    return series.where(F.col("tag") == tag).select("run", "step", "value")


def config_names(spark: SparkSession, text: str) -> DataFrame:
    """Dotted names of a YAML-like text's keys (nested by indent); comments and list items are skipped."""
    names, stack = [], []
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body.strip() or body.lstrip().startswith("- ") or ":" not in body:
            continue
        depth = len(body) - len(body.lstrip())
        stack = [x for x in stack if x[0] < depth] + [(depth, body.strip().split(":", 1)[0])]
        names.append((".".join(k for _, k in stack),))
    return spark.createDataFrame(names, "name string")


def hub_export(spark: SparkSession, root: str, name: str, config: str = "default", split: str = "train") -> DataFrame:
    """A data set's split from a local export in Parquet, one folder per name, configuration and split."""
    return spark.read.parquet(f"{root}/{name.replace('/', '__')}/{config}/{split}")


def staged(spark: SparkSession, url: str, folder: str, fetch: Callable[[str], bytes]) -> str:
    """Path of a file in a shared folder; fetched and written there once if it isn't there yet.

    It is written under a name of its own and renamed, so a fetch or write that fails leaves nothing that a later call
    would take for the file.
    """
    path = f"{folder}/{url.rsplit('/', 1)[-1]}"
    if not exists(spark, path):
        body = fetch(url)
        made, final = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.{uuid.uuid4().hex}.part", path))
        fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(made, False)
        try:
            out.write(bytearray(body))
        finally:
            out.close()
        if not fs.rename(made, final):
            fs.delete(made, False)
            if not exists(spark, path):  # else another call was first
                raise OSError(f"could not write {path}")
    return path
