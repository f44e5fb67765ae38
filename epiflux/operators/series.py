"""Keyed daily series: differences, smoothing, onset."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_cases(df: DataFrame, key: str, date: str, total: str) -> DataFrame:
    """Add ``new_cases``: the difference to the previous day; NULL on the first."""
    by_day = Window.partitionBy(key).orderBy(date)
    return df.withColumn("new_cases", F.col(total) - F.lag(total).over(by_day))


def gaussian_smooth(df: DataFrame, key: str, date: str, value: str, span: int = 7, std: float = 2.0) -> DataFrame:
    """Add ``smoothed``: a centred Gaussian mean over ``span`` rows, rounded half to even.

    Weights are renormalised over the cells that exist, so edges and gaps still
    get a value.
    """
    by_day = Window.partitionBy(key).orderBy(date)
    half = span // 2
    top, base = [], []
    for k in range(-half, half + 1):
        weight = F.lit(math.exp(-0.5 * (k / std) ** 2))
        cell = F.lead(value, k).over(by_day) if k >= 0 else F.lag(value, -k).over(by_day)
        top.append(F.when(cell.isNotNull(), weight * cell).otherwise(F.lit(0.0)))
        base.append(F.when(cell.isNotNull(), weight).otherwise(F.lit(0.0)))
    numerator, denominator = top[0], base[0]
    for add_top, add_base in zip(top[1:], base[1:]):
        numerator, denominator = numerator + add_top, denominator + add_base
    return df.withColumn(
        "smoothed", F.when(denominator > 0, F.bround(numerator / denominator, 0))
    )


def onset_cut(df: DataFrame, key: str, date: str, value: str, cutoff: float) -> DataFrame:
    """Keep each key's rows from the first day ``value`` reaches ``cutoff``; others vanish."""
    whole = Window.partitionBy(key)
    start = F.min(F.when(F.col(value) >= cutoff, F.col(date))).over(whole)
    return df.withColumn("_start", start).filter(F.col(date) >= F.col("_start")).drop("_start")


def prepare_cases(df: DataFrame, key: str, date: str, total: str, cutoff: float = 25) -> DataFrame:
    """Cumulative totals to ``(key, date, new_cases, smoothed)`` from the onset on."""
    smooth = gaussian_smooth(new_cases(df, key, date, total), key, date, "new_cases")
    return onset_cut(smooth, key, date, "smoothed", cutoff).select(key, date, "new_cases", "smoothed")
