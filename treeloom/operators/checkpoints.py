"""Cutting lineage on storage that outlives an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Whether an action's shuffle files go when it ends; by default they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` read from its checkpoint; the shuffle files it was made from are not needed any more and go."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, made under this setting
    finally:
        conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or one set before on the
    context. Where neither is set, a local master gets a folder of its own; a cluster gets an error, because
    its executors would not see such a folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir()
