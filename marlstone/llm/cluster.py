"""Shared cluster helpers: where lineage is cut, how many partitions, distributed components, packed shuffles."""

from __future__ import annotations

import itertools
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read from there.

    The folder is the session's spark.checkpoint.dir; only a session on one machine (local tests) has another where that
    is unset, and on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = shared or os.path.join(tempfile.gettempdir(), "checkpoints")  # one machine
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a further column, and its name: a number for each pair of doc_id and text.

    It is the id itself where that has one text.  Where an id has several, the text of least MD5 keeps it and each other
    text gets a number beyond all ids; so do texts without an id, one number for all their rows, beyond these.  Where the
    ids leave no room there, numbers are hashes that are no id.  Null text is empty.
    """
    name, key, old, of, new = (fresh(docs, x) for x in ("row_id", "text_key", "old_id", "of_key", "new_id"))
    rows = docs.withColumns({name: F.col("doc_id").cast("long"), key: F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    ids = rows.select(F.col(name).alias("id"), F.col(key).alias("key"))
    several = cut(ids.groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most OR id IS NULL"))
    if not several.take(1):
        return rows.drop(key), name
    more = ids.distinct().join(several.withColumnRenamed("id", "own"), F.col("id").eqNullSafe(F.col("own"))).where("id IS NULL OR key <> least").select("id", "key")
    top = max(0, ids.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    if top < 1 << 61:
        number = F.monotonically_increasing_id() + F.when(F.col("id").isNull(), 1 << 60).otherwise(0)
        more = cut(more.withColumn("new", top + 1 + number))
    else:
        for salt in itertools.count():
            tried = cut(more.withColumn("new", F.xxhash64(F.lit(salt), "id", "key")))
            if not tried.groupBy("new").count().where("count > 1").take(1) and not tried.join(ids.select(F.col("id").alias("new")), "new", "left_semi").take(1):
                more = tried
                break
    more = more.select(F.col("id").alias(old), F.col("key").alias(of), F.col("new").alias(new))
    rows = rows.join(more, F.col(old).eqNullSafe(F.col(name)) & (F.col(of) == F.col(key)), "left")
    return rows.withColumn(name, F.coalesce(new, name)).drop(key, old, of, new), name


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BUCKET_BYTES = 64 << 20


def buckets_for(docs: DataFrame) -> int:
    """Partitions for what is made of docs and held whole by a task: by the size of what docs reads, as Catalyst knows it.

    At least the session's number of shuffle partitions; that alone where Catalyst knows no size.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts(docs.sparkSession), min(size // BUCKET_BYTES + 1, 1 << 20)) if size < 1 << 60 else parts(docs.sparkSession)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Range buckets of well mixed 64-bit keys: sorted keys have sorted buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def dealt(rows: DataFrame, sizes: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on key and salt, in which the rows of a frequent key are dealt over several salts.

    sizes: one row for each key, with n_rows, how many of rows have it (about).  A key gets as many salts as its share of
    all rows needs, for four parts of the session's shuffle partitions; its row of sizes is repeated for each.  Of keys
    with more than one salt there are no more than four times the partitions, and only these are broadcast.
    """
    some = 4 * parts(rows.sparkSession)
    total = sizes.agg(F.greatest(F.sum("n_rows"), F.lit(1))).scalar()
    sizes = sizes.withColumn("salts", F.ceil(F.col("n_rows") * some / total).cast("int"))
    hot = F.broadcast(sizes.where("salts > 1").select(F.col(key).alias("hot_key"), F.col("salts").alias("hot_salts")))
    rows = rows.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("salt", F.pmod(F.xxhash64(*by), F.coalesce("hot_salts", F.lit(1))).cast("int"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest("salts", F.lit(1)) - 1)))
    return rows.drop("hot_key", "hot_salts"), sizes.drop("salts", "n_rows")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component) with the least node as component.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum and a join; the edge list
    never leaves the executors.  A node of very many edges is the least of its neighbourhood sooner or later; its edges
    then stay as they are, so only nodes that move and have edges to follow are on the join's other side; the edges of a
    node with a large share of all are dealt over several keys.  Nodes without an edge are absent; an empty input gives an empty output.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    for _ in range(2):  # in a dense group all edges soon lead to a few nodes, so less is left for the joins
        least = e.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        e = least.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
    e = cut(e)
    for _ in range(limit):
        both = e.select("a", "b", F.lit(0).alias("down")).union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1)))
        nodes = both.groupBy("a").agg(F.min("b").alias("m"), F.max("down").alias("down"), F.count_if(F.col("down") == 0).alias("up"), F.count_if(F.col("down") == 1).alias("n_rows")).persist()
        if not nodes.where("up > 1 OR up > 0 AND down = 1").take(1):  # each node but the roots has one edge, to its root
            nodes.unpersist()
            break
        moves = nodes.where("down = 1 AND m < a").select(F.col("a").alias("b"), "m", "n_rows")
        own, moves = dealt(e, moves, "b", ["a"])
        large = own.join(moves, ["b", "salt"], "left")
        large = large.select("a", F.coalesce("m", "b").alias("b")).repartition(parts(e.sparkSession), "a")  # for both that follow
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        e = cut(small)
        nodes.unpersist()
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
