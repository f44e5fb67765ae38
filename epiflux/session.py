"""Session settings and the shared folder used for scratch tables and checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "epiflux", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written against.

    UTC keeps date bucketing independent of the host.  AQE coalesces the small
    shuffles of daily tables and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # no stack trace per column call: plans here are built from many small expressions
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master, where driver and
    executors are one process; a cluster must name a shared folder.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="epiflux-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), "epiflux", f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """The frame as a parquet table in the shared folder.

    For results that several branches or passes of a plan need: lineage ends here,
    they are computed once, keep column pruning and real size statistics, and
    survive the loss of an executor.  A filter on ``by`` reads its own files only.
    """
    path = scratch(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
