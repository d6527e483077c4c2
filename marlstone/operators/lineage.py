"""Cutting lineage between rounds of an iteration."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's spark.checkpoint.dir and read from there.

    Only a session on one machine (local tests) has a folder of our own where that is unset; on a cluster it is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint()
