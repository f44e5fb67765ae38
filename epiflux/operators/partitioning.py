"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give row-wise heavy work enough tasks when the scan has fewer splits than cores.

    A table of many splits comes back as it is, so large inputs are never
    shuffled for this.  The split is by ``key``, which a retried task repeats.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, key) if df.rdd.getNumPartitions() < cores else df
