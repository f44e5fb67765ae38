"""Sinks and format conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiflux.sources.readers import read_delimited

# quotes are doubled and outer spaces kept, so texts come back as they were
DELIMITED = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def flat_columns(df: DataFrame) -> DataFrame:
    """Arrays joined by commas, for line-based files."""
    return df.select(
        *[
            F.array_join(F.col(f"`{field.name}`"), ",").alias(field.name)
            if isinstance(field.dataType, T.ArrayType) else F.col(f"`{field.name}`")
            for field in df.schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write parquet, JSON lines, or tab-separated text (arrays joined by commas)."""
    if fmt == "tsv":
        flat_columns(df).write.mode(mode).options(sep="\t", **DELIMITED).csv(path)
    elif fmt == "csv":
        df.write.mode(mode).options(**DELIMITED).csv(path)
    elif fmt in ("parquet", "json"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: parquet, json, csv or tsv")
    return path


def convert_csv(spark: SparkSession, path: str, out: str, fmt: str, schema) -> DataFrame:
    """Read a CSV, write it as JSON or parquet, and return the frame that was read."""
    if fmt not in ("json", "parquet"):
        raise ValueError("convert to 'json' or 'parquet'")
    frame = read_delimited(spark, path, schema)
    write_table(frame, out, fmt)
    return frame
