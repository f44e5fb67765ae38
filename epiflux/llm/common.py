"""Helpers shared by the operators: size-checked id joins and digests."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids of eight bytes that a join by id may broadcast (32 MB); beyond, the join shuffles.
BROADCAST_IDS = 4_000_000

#: Rows that go to a Python worker at once: texts may be long, so fewer than Spark's 10,000.
BATCH_ROWS = 250


def in_small_batches(spark: SparkSession) -> None:
    """Let Python workers take ``BATCH_ROWS`` rows at a time from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def kept_by_worker(make: Callable):
    """What ``make`` returns, made once in a Python worker and kept for all of its tasks.

    Functions travel by value, so their modules are new in every task; what is kept stands
    in a module of its own.  ``make`` takes no arguments and is known by its name.
    """
    room = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker"))
    name = f"{make.__module__}.{make.__qualname__}"
    if not hasattr(room, name):
        setattr(room, name, make())
    return getattr(room, name)


def by_ids(frame: DataFrame, column: str, ids: DataFrame, how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``frame`` whose ``column`` is (``left_semi``) or is not (``left_anti``) in ``ids``.

    ``ids`` has one column and should be a written table: it is counted first.  Up to
    ``limit`` ids are broadcast, so that wide rows need no shuffle; more ids are
    joined by a shuffle.  The rows are the same either way.  A NULL is in no list.
    """
    key = ids.columns[0]
    ids = ids.select(F.col(key).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    small = ids.limit(limit + 1).count() <= limit
    return frame.join(F.broadcast(ids) if small else ids, frame[column] == ids["_id"], how)


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` when divided by ``folds``; false for NULL."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``frame`` is called so."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def beta_strength(groups: DataFrame, least: float = 2.0, most: float = 10_000.0) -> tuple[float, float]:
    """Overall rate and strength of a beta prior fitted by moments to groups of ``k`` out of ``n``.

    The strength is the number of rows that the prior counts for: small where the rates
    of the groups differ by more than chance, ``most`` where they do not.  No groups
    give a rate of one half.
    """
    n, k = F.col("n"), F.col("k")
    row = groups.agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("groups"),
        F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk"),
    ).first()
    if not row.n:
        return 0.5, least
    rate = row.k / row.n
    # sum of n * (k / n - rate) ** 2, against what chance and the differences of groups add to it
    between = row.kk - row.n * rate * rate
    free = row.n - row.nn / row.n
    chance = (row.groups - 1) * rate * (1 - rate)
    variance = (between - chance) / free if free > 0 else 0.0
    strength = rate * (1 - rate) / variance - 1 if variance > 0 else most
    return rate, min(most, max(least, strength))


def with_verdicts(rows: DataFrame, verdicts: DataFrame, key: str, verdict: str, share: int = 256) -> DataFrame:
    """Left join of ``host, n, verdict`` to rows by ``key``, however the rows are spread over hosts.

    Hosts of at least one in ``share`` of all rows number ``share`` at most: their
    verdicts are broadcast and their rows stay where they are.  The others are joined by
    a shuffle, in which no host holds more than that share.  ``verdict`` names a column that
    ``rows`` does not have.
    """
    host = fresh(rows, "_host")
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    least = total / share
    big = F.broadcast(verdicts.filter(F.col("n") >= least).select(F.col("host").alias(host), verdict))
    small = verdicts.filter(F.col("n") < least).select(F.col("host").alias(host), verdict)
    same = rows[key] == F.col(host)
    here = rows.join(big, same, "inner").drop(host)
    rest = rows.join(big.select(host), same, "left_anti")
    known = rest.filter(F.col(f"`{key}`").isNotNull())
    unknown = rest.filter(F.col(f"`{key}`").isNull()).withColumn(verdict, F.lit(None).cast("boolean"))
    there = known.join(small, known[key] == F.col(host), "left").drop(host)
    return here.unionByName(there).unionByName(unknown)
