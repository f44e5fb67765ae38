"""Whole-column statistics that stay distributed and exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Buckets that ranks are found in, by halving: a power of two.
BUCKETS = 1024


def _bucket(value, cuts):
    """How many of the sorted cuts are at most the value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(BUCKETS.bit_length() - 1))])

    def step(at, size):
        ahead = at + size
        fits = (ahead <= F.size(cuts)) & (F.get(cuts, ahead - 1) <= value)
        return F.when(fits, ahead).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def profile_columns(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """One row per column: ``n``, ``mean``, ``std``, ``min``, ``max`` and quantiles ``q0, q1, ...``.

    All columns share one scan.  Values are counted first, so a value that fills
    most rows weighs one row.  Distinct values are cut at approximate quantiles of
    their own, so buckets follow the distribution whatever its tails, and ranked inside
    their bucket on top of the bucket's offset; only the bucket totals are ordered in
    one place.  The cuts decide how work is spread, not the result.  Quantiles are
    interpolated linearly.
    """
    cells = F.array(
        *[F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("v")) for name in columns]
    )
    counts = (
        df.select(F.inline(cells)).filter(F.col("v").isNotNull())
        .groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    span = counts.groupBy("column").agg(
        F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("cuts"),
        F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    v, n = F.col("v"), F.col("n")
    # one row per listed column
    placed = counts.join(F.broadcast(span), "column").withColumn("bucket", _bucket(v, F.col("cuts"))).drop("cuts")
    before = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("column", "bucket").agg(F.sum("n").alias("size")).select(
        "column", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift")
    )
    inside = Window.partitionBy("column", "bucket").orderBy("v")
    ranked = placed.join(offsets, ["column", "bucket"]).withColumn(
        "upto", F.col("shift") + F.sum("n").over(inside)
    )
    ends = []
    for i, p in enumerate(probabilities):
        target = F.lit(float(p)) * (F.col("total") - 1)
        for rank, side in ((F.floor(target), "lo"), (F.ceil(target), "hi")):
            hit = (F.col("upto") - n <= rank) & (rank < F.col("upto"))
            ends.append(F.max(F.when(hit, v)).alias(f"{side}{i}"))
    rows = ranked.groupBy("column").agg(
        F.sum("n").alias("n"), F.first("mean").alias("mean"),
        F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("squares"),
        F.min("v").alias("min"), F.max("v").alias("max"), *ends,
    )
    quantiles = []
    for i, p in enumerate(probabilities):
        target = F.lit(float(p)) * (F.col("n") - 1)
        between = F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (target - F.floor(target))
        quantiles.append(between.alias(f"q{i}"))
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return rows.select("column", "n", "mean", deviation.alias("std"), "min", "max", *quantiles)


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """One row with ``n`` and the quantiles ``q0, q1, ...`` of a column."""
    profile = profile_columns(df, [column], probabilities)
    return profile.select("n", *[f"q{i}" for i in range(len(probabilities))])


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one row per column."""
    profile = profile_columns(df, columns, [0.25, 0.5, 0.75])
    return profile.withColumnsRenamed({"n": "count", "q0": "p25", "q1": "p50", "q2": "p75"})


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between the extremes; the last bin is closed."""
    value = F.col(column).cast("double")
    data = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    span = data.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")))
    low, high = F.col("span.low"), F.col("span.high")
    at = F.when(
        high > low, F.least(F.floor((F.col("v") - low) * bins / (high - low)), F.lit(bins - 1))
    ).otherwise(F.lit(0)).cast("int")
    placed = data.withColumn("span", span.scalar()).select(at.alias("bin"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def rate(flag: str, scale: float = 100.0):
    """Share of rows that carry a 0/1 flag, in percent; NULL flags stay in the base."""
    return F.sum(flag) / F.count(F.lit(1)) * F.lit(scale)


def fill_by_share(df: DataFrame, flag: str, id_column: str, share: Column, seed: int = 0) -> DataFrame:
    """Fill a missing 0/1 flag with ones by ``share``.

    The draw is a digest of the row's id, so a retried task fills the same value.  Without
    a share, as where no row has the flag, zeros are filled.
    """
    digest = F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    filled = F.when(F.col(flag).isNotNull(), F.col(flag)).when(draw < share, F.lit(1)).otherwise(F.lit(0))
    return df.withColumn(flag, filled)


def impute_by_share(df: DataFrame, flag: str, id_column: str, seed: int = 0) -> DataFrame:
    """Fill a missing 0/1 flag by the observed share of ones."""
    return fill_by_share(df, flag, id_column, df.select(F.mean(flag).alias("p")).scalar(), seed)
