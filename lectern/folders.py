"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's own; one is made up only where driver and executors are one process.

    On a cluster that names none this raises an error: a folder of one
    machine would be missing on the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            master = context.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        at = context._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    # held meanwhile, as the checkpoint is a job of its own that would compute all again
    held = df.persist(StorageLevel.DISK_ONLY)
    out = held.checkpoint()
    held.unpersist()
    return out
