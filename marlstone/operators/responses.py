"""A table of model answers that is written while they arrive, and read by later tasks, jobs and runs.

A task commits its answers in small files, each written under a hidden name and then renamed, so a file is whole or not
there.  A name holds the job, the partition, the attempt and a count.  A task that is run again reads what its earlier
attempts committed and asks for the rest only; so does a job that is started again, for whatever another job committed.
Two attempts that ran at once may both commit an answer; a reader takes one of them, the same each time.

A request is told by its row's key, the messages, the parameters and the model's name; an answer to other settings never
fits.  Failed calls are kept too, until an answer comes: they are asked again by the next job.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWERS = "request string, sample_idx int, content string, prompt_tokens int, completion_tokens int, finish_reason string, error string"
_FIELDS = pa.schema([("request", pa.string()), ("sample_idx", pa.int32()), ("content", pa.string()), ("prompt_tokens", pa.int32()), ("completion_tokens", pa.int32()), ("finish_reason", pa.string()), ("error", pa.string())])


@dataclass(frozen=True)
class StoredClient:
    """A client whose answers are kept at path, a folder that the driver and all executors see.

    A task commits after commit_rows answers, or at the first one that comes commit_seconds after the last commit: so
    much is asked again if it is lost.
    """

    inner: object
    path: str
    name: str = "model"
    commit_rows: int = 64
    commit_seconds: float = 10.0

    def chat(self, messages: list[dict], **parameters) -> dict:
        return self.inner.chat(messages, **parameters)


def request_id(name: str, parameters: str, key: Column, messages: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(name), F.lit(parameters), key, F.to_json(messages)), 256)


def answered(spark: SparkSession, path: str) -> DataFrame:
    """One row of ANSWERS for each request and sample that path has: an answer if there is one, else a failure."""
    files, root = _files(path)
    files.create_dir(root, recursive=True)
    rows = spark.read.schema(ANSWERS).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    best = F.min_by(F.struct("content", "prompt_tokens", "completion_tokens", "finish_reason", "error"), F.struct(F.col("error").isNotNull(), "file")).alias("a")
    return rows.groupBy("request", "sample_idx").agg(best).select("request", "sample_idx", "a.*")


def compact(spark: SparkSession, path: str, partitions: int = 8) -> None:
    """The same answers in few files.  No job may be writing; one that is lost half-way leaves some answers twice, not fewer."""
    before = [r[0] for r in spark.read.schema(ANSWERS).parquet(path).select(F.input_file_name()).distinct().collect()]  # one row a file
    answered(spark, path).repartition(partitions, "request").write.mode("append").parquet(path)
    for f in before:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)


def _files(path: str):
    """The file system and folder of a path, as driver and tasks open it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))


class Commits:
    """The files of one partition of a job."""

    def __init__(self, path: str, job: str, partition: int, attempt: int):
        self.fs, self.root = _files(path)
        self.prefix, self.attempt, self.n = f"{job}-{partition:06d}-", attempt, 0

    def earlier(self) -> set[tuple[str, int]]:
        """Requests and samples that earlier attempts have answers of."""
        if not self.attempt:
            return set()
        import pyarrow.parquet as pq
        from pyarrow import fs

        names = [f.path for f in self.fs.get_file_info(fs.FileSelector(self.root)) if f.base_name.startswith(self.prefix)]
        tables = [pq.read_table(self.fs.open_input_file(f), columns=["request", "sample_idx", "error"]) for f in names]
        return {(r["request"], r["sample_idx"]) for t in tables for r in t.to_pylist() if r["error"] is None}

    def add(self, rows: list[tuple]) -> None:
        import pyarrow.parquet as pq

        name = f"{self.prefix}{self.attempt}-{self.n:06d}.parquet"
        self.n += 1
        table = pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)
        with self.fs.open_output_stream(f"{self.root}/_{name}") as f:
            pq.write_table(table, f)
        self.fs.move(f"{self.root}/_{name}", f"{self.root}/{name}")


def as_they_come(pool: ThreadPoolExecutor, ask: Callable, items: Iterable, in_flight: int):
    """Results of ask(item) in the order in which they come, with in_flight requests open at once."""
    open_: set = set()
    for item in items:
        open_.add(pool.submit(ask, item))
        if len(open_) >= in_flight:
            done, open_ = wait(open_, return_when=FIRST_COMPLETED)
            yield from (f.result() for f in done)
    while open_:
        done, open_ = wait(open_, return_when=FIRST_COMPLETED)
        yield from (f.result() for f in done)


def recorder(client: StoredClient, job: str, ask: Callable[[dict], list[tuple]], in_flight: int):
    """(key, sample_idx, n, messages, request) asked and committed; ask gives rows of a key and what CALLS has after it.

    Returns how many requests were asked.
    """

    def run(batches):
        context = TaskContext.get()
        commits = Commits(client.path, job, context.partitionId(), context.attemptNumber())
        have, held, last, asked = commits.earlier(), [], time.time(), 0
        todo = (r for b in batches for r in b.to_pylist() if not all((r["request"], r["sample_idx"] + k) in have for k in range(r["n"])))
        with ThreadPoolExecutor(in_flight) as pool:
            for rows in as_they_come(pool, lambda r: [(r["request"], *x[1:]) for x in ask(r)], todo, in_flight):
                held += rows
                asked += 1
                if len(held) >= client.commit_rows or time.time() - last >= client.commit_seconds:
                    commits.add(held)
                    held, last = [], time.time()
        if held:
            commits.add(held)
        yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], names=["asked"])

    return run


def through(todo: DataFrame, client: StoredClient, settings: str, ask: Callable[[dict], list[tuple]], in_flight: int) -> DataFrame:
    """todo: (key, messages, sample_idx, n): n samples from sample_idx on by one request.  Rows of CALLS for all of them.

    What the table lacks is asked for now, by one job; the rows that are returned are read from the table, so that no
    later action asks again.
    """
    spark = todo.sparkSession
    todo = todo.withColumn("request", request_id(client.name, settings, F.col("key"), F.col("messages")))
    each = todo.select("key", "request", F.explode(F.sequence(F.col("sample_idx"), F.col("sample_idx") + F.col("n") - 1)).alias("sample_idx"))
    done = answered(spark, client.path).where("error IS NULL").select("request", "sample_idx")
    lacking = each.join(done, ["request", "sample_idx"], "left_anti").select("request", F.col("sample_idx").alias("lacks")).distinct()
    asked = todo.join(lacking, "request").where("lacks BETWEEN sample_idx AND sample_idx + n - 1").dropDuplicates(["request", "sample_idx"])
    asked = asked.select("key", "sample_idx", "n", "messages", "request").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "request")
    asked.mapInArrow(recorder(client, uuid.uuid4().hex, ask, in_flight), "asked long").agg(F.sum("asked")).collect()
    return each.join(answered(spark, client.path), ["request", "sample_idx"]).drop("request")
