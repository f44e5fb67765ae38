"""Named tables: parquet files of a data folder, or catalog tables."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``name`` as a frame, pruned to ``columns`` when given."""
    frame = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return frame.select(*columns) if columns else frame


def save_catalog_table(df: DataFrame, name: str, path: str, by: str) -> None:
    """Write a frame as a catalog table with a folder for each value of ``by``, below ``path``.

    Rows are dealt out by ``by`` and by part of their digest, so a value with most of the
    rows is written by several tasks, and a value has a few files.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{column}`") for column in df.columns]), F.lit(8))
    dealt = df.repartition(F.col(by), part)
    dealt.write.mode("overwrite").partitionBy(by).option("path", path).format("parquet").saveAsTable(name)


def catalog_table(spark: SparkSession, name: str, where: Column | None = None) -> DataFrame:
    """A table the session's catalog knows, whatever connector backs it.

    A condition on the table's partition column reads its folders only.
    """
    frame = spark.table(name)
    return frame if where is None else frame.filter(where)


def sql_over(spark: SparkSession, statement: str, **views: DataFrame) -> DataFrame:
    """Run a statement over frames given as named arguments (``{name}`` in the text)."""
    return spark.sql(statement, **views)


def fixed_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small table of fixed values, held in the plan itself."""
    columns = [field.split()[0] for field in schema.split(", ")]
    rows = list(rows)
    data = pa.table({name: [row[i] for row in rows] for i, name in enumerate(columns)})
    return spark.createDataFrame(data, schema)
