"""Cutting lineage in iterative plans, and broadcasts that check sizes first."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast; larger sides are left to the optimizer.
BROADCAST_ROWS = 2_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of this session's own where none is set, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a folder that they share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wayfare-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; survives lost executors."""
    spark = df.sparkSession
    directory = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(directory)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, by a bounded count; as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
