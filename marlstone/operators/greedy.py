"""A greedy pass in key order, decided for all rows at once: a row stays if no earlier row that stays is near to it.

Whether a row stays depends on its earlier neighbours, so a chain of near rows hangs on its first.  Such paths are
contracted: a row with one open neighbour stays exactly if that one doesn't, which lets every row that hangs on it point to
that neighbour's neighbour, with a flip.  Each round at least halves what is left of a path.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.lineage import cut


#: So many edges are decided by one task, in the order of their rows; more are contracted by joins.
ONE_TASK = 500_000


def settle(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """nodes: (key, complete); edges: distinct (late, early) of undecided nodes.  (key, stays) of nodes that can be decided.

    complete: all edges to earlier rows are known; another row can only be decided by an earlier neighbour that stays.
    Keys are whole numbers.
    """
    if edges.count() > one_task:
        return contracted(nodes, edges)
    lone = nodes.where("complete").join(edges.select(F.col("late").alias("key")), "key", "left_anti").select("key", F.lit(True).alias("stays"))
    of = [nodes.select(F.col("key").alias(x), F.col("complete").alias(f"{x}_complete")) for x in ("late", "early")]
    both = edges.join(of[0], "late").join(of[1], "early").select("late", "early", "late_complete", "early_complete")
    return lone.union(both.coalesce(1).mapInArrow(_in_order, "key long, stays boolean"))


def _in_order(batches):
    """All edges, in one task, to (key, stays) of the later rows that can be decided."""
    cols = [np.concatenate(c) for c in zip(*([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches), strict=True)]
    if not cols:
        return
    late, early, late_complete, early_complete = cols
    stays: dict[int, bool | None] = {k: True if done else None for k, done in zip(early.tolist(), early_complete.tolist(), strict=True)}
    order = np.argsort(late, kind="stable")
    heads = np.flatnonzero(np.diff(late[order], prepend=late[order[0]] - 1))
    for own in np.split(order, heads[1:]):
        near = {stays[k] for k in early[own].tolist()}
        stays[int(late[own[0]])] = False if True in near else None if None in near or not late_complete[own[0]] else True
    made = [(k, stays[k]) for k in late[order[heads]].tolist() if stays[k] is not None]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([v for _, v in made], pa.bool_())], names=["key", "stays"])


def contracted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """settle by rounds of joins, as many as the logarithm of the longest path.

    deps: (key, par, flip), a condition that has to be false for key to stay: that par stays, or with flip that it doesn't.
    """
    open_ = nodes.select("key", "complete")
    deps = edges.select(F.col("late").alias("key"), F.col("early").alias("par"), F.lit(False).alias("flip"))
    known, fell = [], False
    while True:
        # a row with both conditions on one neighbour is near to a row that stays, whichever of the two it is
        by = deps.groupBy("key", "par").agg(F.min("flip").alias("flip"), (F.min("flip") != F.max("flip")).alias("both"))
        by = by.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("both").alias("both"), F.min(F.struct("par", "flip")).alias("only"))
        free, hangs = F.col("complete") & F.col("n").isNull(), F.col("complete") & (F.col("n") == 1) & ~F.col("both")
        state = cut(open_.join(by, "key", "left").select("key", "complete", F.when(F.col("both"), False).when(free, True).alias("stays"), F.when(hangs, F.col("only")).alias("only")))
        done = state.where("stays IS NOT NULL").select("key", "stays")
        known.append(done)
        of = state.where("only IS NOT NULL").select(F.col("key").alias("of"), "stays", "only")
        decided = reduce(DataFrame.union, known)  # paths lead to rows of earlier rounds too
        of = of.union(decided.select("key", "stays", F.lit(None).cast(of.schema["only"].dataType)))
        left = deps.join(done.select("key"), "key", "left_anti").join(of, F.col("par") == F.col("of"), "left")
        moved = F.col("only").isNotNull()
        left = left.select("key", (F.col("stays") != F.col("flip")).alias("holds"), F.coalesce("only.par", "par").alias("par"), F.when(moved, F.col("flip") == F.col("only.flip")).otherwise(F.col("flip")).alias("flip"), moved.alias("moved"))
        left = cut(left.where("holds IS NULL OR holds").distinct())
        gone = left.where("holds").select("key").distinct()
        known.append(gone.withColumn("stays", F.lit(False)))
        had, fell = fell, bool(gone.take(1))
        if not (had or fell or done.take(1) or left.where("moved").take(1)):
            return reduce(DataFrame.union, known)
        open_ = state.where("stays IS NULL").select("key", "complete").join(gone, "key", "left_anti")
        deps = left.where("holds IS NULL").join(gone, "key", "left_anti").select("key", "par", "flip").distinct()
