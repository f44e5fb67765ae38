"""Daily signal tables: counts per day and term, peaks, top terms, wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most columns of a wide table; beyond, the long table is the one to keep.
MAX_COLUMNS = 10_000


def daily_counts(df: DataFrame, date: Column, term: Column) -> DataFrame:
    """``(date, term, volume)``; ``term`` may be an array, then every element counts."""
    rows = df.select(date.alias("date"), term.alias("term"))
    if dict(rows.dtypes)["term"].startswith("array"):
        # outer, so that no emptiness test is pushed down to compute the array twice
        rows = rows.select("date", F.explode_outer("term").alias("term")).filter("term IS NOT NULL")
    return rows.groupBy("date", "term").agg(F.count(F.lit(1)).alias("volume"))


def daily_top_terms(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms of each day, ranked; ties in term order.

    The rank limit is applied to every partition before the shuffle, so a day
    sends at most ``k`` rows per task however many terms it has.
    """
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("volume"), "term"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def peaks(counts: DataFrame) -> DataFrame:
    """Highest daily volume of each term."""
    return counts.groupBy("term").agg(F.max("volume").alias("peak"))


def top_by_peak(counts: DataFrame, n: int | None, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Terms by descending peak, cut to ``n`` and then filtered by pattern.

    The filter follows the cut, so it may leave fewer than ``n`` terms.
    """
    ranked = peaks(counts)
    if n is not None:
        ranked = ranked.orderBy(F.desc("peak"), "term").limit(n)
    if keep is not None:
        ranked = ranked.filter(F.col("term").rlike(keep))
    if drop is not None:
        ranked = ranked.filter(~F.col("term").rlike(drop))
    return ranked


def pivot_daily(counts: DataFrame, terms: list[str]) -> DataFrame:
    """One row per date, one column per listed term.

    Pass the short list a top-by-peak cut gives.  A repeated (date, term) is an error.
    """
    volume = F.when(
        F.count("volume") > 1, F.raise_error(F.lit("repeated date and term"))
    ).otherwise(F.max("volume"))
    return counts.groupBy("date").pivot("term", terms).agg(volume)


def top_terms_pivot(counts: DataFrame, n: int, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Wide table of the ``n`` terms with the highest peaks, highest first.

    Only the term names (at most ``n``) reach the driver, to name the columns.
    """
    chosen = top_by_peak(counts, n, keep, drop).orderBy(F.desc("peak"), "term")
    return pivot_daily(counts, [row.term for row in chosen.select("term", "peak").collect()])


def top_names(counts: DataFrame, n: int | None, keep: str | None = None, drop: str | None = None) -> list[str]:
    """Terms of a wide table, highest peak first, on the driver; more than ``MAX_COLUMNS`` are refused."""
    chosen = top_by_peak(counts, n, keep, drop).orderBy(F.desc("peak"), "term").limit(MAX_COLUMNS + 1)
    names = [row.term for row in chosen.collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns: cut them by peak or pattern")
    return names


def wide_records(counts: DataFrame, terms: list[str]) -> DataFrame:
    """``date, volumes``: one record per date, the listed terms as the fields of a map, in the given order.

    The form of a wide table that goes to JSON: fields may differ in case only, hold dots or
    be called ``date``, which columns may not.  Every date of ``counts`` has a record with
    every field, NULL where the term has no volume.  A repeated (date, term) is an error.
    A record holds at most as many cells as there are terms, however many rows its date has.
    """
    listed = F.broadcast(counts.sparkSession.createDataFrame([(term,) for term in terms], "term string"))
    found = counts.join(listed.withColumn("_listed", F.lit(True)), "term", "left")
    cell = F.when(F.col("_listed"), F.struct("term", "volume"))
    by_date = found.groupBy("date").agg(F.map_from_entries(F.collect_list(cell)).alias("_cells"))
    names = F.array(*[F.lit(term) for term in terms]).cast("array<string>")
    return by_date.select("date", F.map_from_arrays(
        names, F.transform(names, lambda term: F.col("_cells")[term])).alias("volumes"))
