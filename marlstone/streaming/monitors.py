"""Structured Streaming over metric files: rules that ask for a stop, a running best, counters, and keyed resumption."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marlstone.operators import windows


def reasons(state: DataFrame, kl: str = "kl", entropy: str = "entropy", score: str = "score") -> DataFrame:
    """state (run, tag, last, best): runs that should stop, with the first reason: three high kl values, three low
    entropies, three scores under the best."""
    why = F.when((F.col("tag") == kl) & windows.all_above(3, 0.5), "kl").when((F.col("tag") == entropy) & windows.all_below(3, 0.1), "entropy").when((F.col("tag") == score) & windows.all_below(3, F.col("best") - 0.03), "score")
    return state.select("run", why.alias("reason")).where("reason IS NOT NULL").groupBy("run").agg(F.min("reason").alias("reason"))


def stop_reasons(series: DataFrame) -> DataFrame:
    """The same of whole series (run, step, tag, value)."""
    return reasons(windows.last_values(series, 3).join(series.groupBy("run", "tag").agg(F.max("value").alias("best")), ["run", "tag"]))


class SeriesState(StatefulProcessor):
    """The last three values with their steps, and the best value, of each series (run, tag); rows of a run to stop."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", "steps array<bigint>, vals array<double>, best double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, best = [], None
        if self.series.exists():
            steps, vals, best = self.series.get()
            last = list(zip(steps, vals, strict=True))
        for batch in rows:
            new = batch[batch["value"].notna()]
            if len(new):
                best = max(float(new["value"].max()), best if best is not None else -math.inf)
                some = new.nlargest(3, "step")
                last = sorted([*last, *zip(some["step"].astype(int).tolist(), some["value"].astype(float).tolist(), strict=True)])[-3:]
        if last:
            self.series.update(([s for s, _ in last], [v for _, v in last], best))
            yield pd.DataFrame({"run": [key[0]], "tag": [key[1]], "last": [[v for _, v in last]], "best": [best]})

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"


def series_states(stream: DataFrame) -> DataFrame:
    """(run, tag, last, best) of the series that a batch brings values of, as they stand after it."""
    return stream.groupBy("run", "tag").transformWithStateInPandas(statefulProcessor=SeriesState(), outputStructType="run string, tag string, last array<double>, best double", outputMode="Update", timeMode="None")


def watch(stream: DataFrame, act: Callable[[list], None], checkpoint: str) -> StreamingQuery:
    """For each batch of metrics: brings its series' states up to date, applies the rules, and hands the runs to act.

    What happens then is act's business; nothing is killed here.  States are kept by series in a state store (RocksDB), so
    a batch reads and writes those of the series that it brings, and a query that is started again goes on from there.
    """
    def batch(df: DataFrame, number: int) -> None:
        act([tuple(r) for r in reasons(df).collect()])  # runs to stop

    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return series_states(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def running_best(stream: DataFrame, tag: str | None = None) -> DataFrame:
    """Best value so far and its first step, per run and tag; for complete mode."""
    rows = stream.where(F.col("tag") == tag) if tag else stream
    best = F.min(F.struct((-F.col("value")).alias("neg"), "step")).alias("b")
    return rows.groupBy("run", "tag").agg(best).select("run", "tag", (-F.col("b.neg")).alias("value"), "b.step")


def progress(rows: DataFrame, name: str | Observation) -> DataFrame:
    """Rows with counters that a query listener (by name) or an observation receives while they are processed."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"))


def append_new(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once.  Without an event time a key is remembered for good, so that no repeat passes, however late.

    With one, keys are forgotten after the delay, which bounds what is remembered; later repeats pass then.
    """
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a query over the input that is there now gives, as a table; for tests and one-off runs."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table(name)
    return out
