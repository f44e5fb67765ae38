"""General table operators: column choice, keep-first, roll-ups, joins by date."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_like(df: DataFrame, pattern: str, without: tuple[str, ...] = ()) -> list[str]:
    """Column names that contain the pattern."""
    return [name for name in df.columns if re.search(pattern, name) and name not in without]


def split_valid(df: DataFrame, column: str, pattern: str = r"\d+") -> tuple[DataFrame, DataFrame]:
    """Rows whose value contains the pattern, and the rest; NULL belongs to the rest."""
    good = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return df.filter(good), df.filter(~good)


def date_window(df: DataFrame, column: str, start, end, inclusive_end_day: bool = False) -> DataFrame:
    """Rows from ``start`` to ``end``; the end is its midnight unless the whole day is wanted."""
    value = F.col(column)
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if inclusive_end_day:
        return df.filter((value >= low) & (value < high + F.expr("INTERVAL 1 DAY")))
    return df.filter(value.between(low, high))


def nulls_last(column: Column) -> list[Column]:
    """Two ordering fields that sort NULL after every value."""
    return [column.isNull().alias("gone"), column.alias("value")]


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given ascending order.

    A min-by aggregate, not a window: rows of a key are reduced before the
    shuffle, so a key that holds most rows is no heavier than any other.
    """
    rest = [name for name in df.columns if name not in keys]
    rank = F.struct(*[column.alias(f"o{i}") for i, column in enumerate(order)])
    first = F.min_by(F.struct(*[F.col(f"`{name}`") for name in rest]), rank).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(*df.columns)


def keep_first_text(df: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """First row per distinct text; groups on a digest so texts are not shuffled as keys."""
    keyed = df.withColumn("_digest", F.sha2(F.col(text), 256))
    return keep_first(keyed, ["_digest"], order).drop("_digest")


def duplicates(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Every row whose key occurs more than once; NULL counts as a value.

    Counts are combined before the shuffle; the repeated keys then select rows by
    a left-semi join, whose row side can be split when one key is hot.
    """
    named = {f"_k{i}": key for i, key in enumerate(keys)}
    keyed = df.withColumns(named)
    repeated = keyed.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = repeated.select(*[F.col(name).alias(f"r{name}") for name in named])
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"r{name}")) for name in named])
    return keyed.join(repeated, same, "left_semi").drop(*named)


def value_counts(df: DataFrame, columns: list[str], keep_null: bool = True) -> DataFrame:
    """Frequencies of several columns in one pass: ``(column, value, n)``."""
    cells = F.array(
        *[F.struct(F.lit(name).alias("column"), F.col(name).cast("string").alias("value")) for name in columns]
    )
    long = df.select(F.inline(cells))
    if not keep_null:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def lookup(
    left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "left", hot_rows: int = 1_000_000,
    spread_by: str | None = None,
) -> DataFrame:
    """Join to a side with one row per key, where a few keys may hold most rows of ``left``.

    Keys with more than ``hot_rows`` rows are spread over as many salts as their
    count asks for, and only their lookup rows are repeated.  There are at most
    ``rows / hot_rows`` such keys, so their table is broadcast.  Rows with a NULL
    key match nothing and are spread too.  Rows are spread by ``spread_by``, a column that
    tells rows of a key apart; without it by a hash of the whole row, which leaves equal
    rows together.
    """
    keys = [keys] if isinstance(keys, str) else keys
    hot = F.broadcast(
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1))
    row = F.xxhash64(*[F.col(f"`{name}`") for name in ([spread_by] if spread_by else left.columns)])
    unknown = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    salt = F.pmod(row, F.when(unknown, F.lit(1024)).otherwise(parts)).cast("int")
    salted = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts")
    repeated = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("_parts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def rollup_members(df: DataFrame, keys: list[str], member: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """Distinct members per key, a row each: ``keys, member, n`` and the or-ed ``flags``.

    The result has this form at every size.  Rows are combined before the shuffle, and
    a key's members are dealt out by member, so a key with most rows is not one group.
    """
    return df.groupBy(*keys, F.col(member).alias("member")).agg(
        F.count(F.lit(1)).alias("n"), *[F.max(F.col(flag)).alias(flag) for flag in flags]
    )


def outer_by_key(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of frames that each have one row per key."""
    return reduce(lambda left, right: left.join(right, key, "full"), frames)


def one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame as aggregated rows, failing at run time when a key repeats."""
    values = [name for name in df.columns if name not in keys]
    guarded = [
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"duplicate key {keys}")))
        .otherwise(F.max(F.col(f"`{name}`"))).alias(name)
        for name in values
    ]
    return df.groupBy(*keys).agg(*guarded)


def union_sparse(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are NULL."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def first_in_both(df: DataFrame, key: str, ascending: str, descending: str) -> DataFrame:
    """Rows that rank first on two orders at once within a key; a NULL never ranks.

    Rank 1 means "equal to the extreme", so two combined extremes and an equi-join
    on them replace two windows over the whole group.
    """
    best = df.groupBy(key).agg(F.min(ascending).alias(ascending), F.max(descending).alias(descending))
    return df.join(best, [key, ascending, descending], "left_semi")
