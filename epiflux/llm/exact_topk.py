"""Exact nearest vectors by inner product with Fagin's threshold algorithm.

Candidates are cut into blocks of bounded size; a block keeps, for each dimension, its rows
sorted by that component.  A query reads all lists from the end that its sign favours, a
round at a time.  Rows that are met are scored whole by random access.  What has not been
met can score no more than the threshold, the sum over the dimensions of the query's
component times the last value read; the search of a block ends when the threshold is
below the k-th best score known.  The first such score comes from the query's own block,
so that most of the other blocks can end early.

Blocks are ranges of rows ordered by their strongest component, so rows of a block are
alike; equal rows are dealt out over blocks too.  Queries meet blocks in groups of bounded
size on either side, over a shuffle; nothing is broadcast or gathered.

Edge cases: components are floor(256 * x) with x as double, limited to 64 bits.  Vectors that
are NULL or hold a NULL, a NaN or an infinite component take no part.  Missing components
of shorter vectors count as 0.  A query's own row is left out, another row with the same id
is not; equal scores go to the smaller id, NULL ids last.  Scores beyond 64 bits are set to
the limit, after they were compared in full.  Fewer than k candidates give fewer rows, an
empty table none.  Other columns are ignored whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiflux.session import stored

#: Rows of a block and queries of a group, about.
BLOCK_ROWS = 8_192
GROUP_QUERIES = 2_048

#: Depth of the first round in each list; every round doubles it.
FIRST_DEPTH = 16

_LONG = 2**63 - 1


def _matrix(values, width: int) -> np.ndarray:
    """Vectors as rows of integers, filled up with zeros."""
    out = np.zeros((len(values), width), np.int64)
    for at, row in enumerate(values):
        out[at, : len(row)] = row
    return out


class SortedLists:
    """Rows of a block and, for each dimension, their order by that component."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray):
        self.numbers, self.values = numbers, values
        self.order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0)

    def top(self, queries: np.ndarray, own: np.ndarray, floor: list, k: int) -> list[list[tuple[int, int]]]:
        """For each query up to ``k`` ``(score, row)``, best first, that reach its ``floor``.

        ``own`` has the number of the query's own row, ``floor`` a score that ``k`` other rows
        are known to reach, or None.  Of equal scores the row that stands first is the better.
        """
        rows, width = self.values.shape
        depths = [0]
        while depths[-1] < rows:
            depths.append(min(rows, max(FIRST_DEPTH, 2 * depths[-1])))
        largest = lambda x: int(np.abs(x.astype(object)).max(initial=0))
        exact = largest(queries) * largest(self.values) * max(1, width) < 2**53
        kind = float if exact else object  # whole numbers of any size where doubles do not hold them
        values, ordered, asked = (x.astype(kind) for x in (self.values, self.sorted, queries))
        # what a row not met within a depth can score at most
        last = np.array([rows - 1 - depth for depth in depths[:-1]])
        high, low = ordered[last], ordered[np.array(depths[:-1])]
        limits = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
        return [
            self._search(asked[i], values, limits[i], depths, own[i], floor[i], k) for i in range(len(asked))
        ]

    def _search(self, query, values, limits, depths, own, floor, k) -> list[tuple[int, int]]:
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(len(values), bool)
        found_rows, found_scores, kth = np.zeros(0, int), np.zeros(0, values.dtype), floor
        for at, limit in enumerate(limits):
            if kth is not None and limit < kth:
                break
            begin, end = depths[at], depths[at + 1]
            n = len(values)
            met = np.zeros(n, bool)
            met[self.order[n - end:n - begin, up]] = True
            met[self.order[begin:end, down]] = True
            if at == len(limits) - 1:
                met[:] = True  # the lists are read to their ends, also those of components of 0
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[self.numbers[new] != own]
            scores = values[new] @ query
            if kth is not None:
                keep = scores >= kth
                new, scores = new[keep], scores[keep]
            found_rows, found_scores = np.concatenate([found_rows, new]), np.concatenate([found_scores, scores])
            if len(found_rows) > k:
                best = np.lexsort((found_rows, -found_scores))[:k]
                found_rows, found_scores = found_rows[best], found_scores[best]
            if len(found_rows) == k and (kth is None or found_scores.min() > kth):
                kth = found_scores.min()
        best = np.lexsort((found_rows, -found_scores))
        return [(int(found_scores[i]), int(found_rows[i])) for i in best]


def _block(rows: pd.DataFrame, width: int) -> SortedLists:
    return SortedLists(rows["number"].to_numpy(np.int64), _matrix(rows["vector"], width))


def whole_numbers(column: str) -> Column:
    """floor(256 * x) of each component as a long; NULL for vectors that take no part."""
    wide = F.col(column).cast("array<double>")
    odd = F.exists(wide, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(wide, lambda x: F.floor(256 * x)))


def _index(rows: DataFrame) -> DataFrame:
    """``id, unnamed, asks, vector, number, block``: rows in blocks, written.

    A row's ``number`` tells rows of the same id apart.  Rows are dealt out by the place and
    sign of their strongest component, then by number, so that many equal rows are spread.
    """
    size = F.transform("vector", lambda x: F.abs(x.cast("double")))
    strongest = F.array_position(size, F.array_max(size))
    sign = F.when(F.element_at("vector", strongest.cast("int")) < 0, -1).otherwise(1)
    cell = F.when(F.size("vector") == 0, 0).otherwise(strongest * sign)
    numbered = rows.withColumns({"number": F.monotonically_increasing_id(), "cell": cell})
    blocks = -(-rows.count() // BLOCK_ROWS) or 1
    dealt = numbered.repartitionByRange(blocks, "cell", "number")
    return stored(dealt.withColumn("block", F.spark_partition_id()).drop("cell"), "topk-blocks")


def _floors(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of the queries of a block, the k-th best score within it."""
    width = max(map(len, rows["vector"]))
    asks = rows[rows["asks"]]
    found = _block(rows, width).top(
        _matrix(asks["vector"], width), asks["number"].to_numpy(np.int64), [None] * len(asks), k)
    floors = [str(best[-1][0]) if len(best) == k else None for best in found]
    return asks[["id", "unnamed", "number", "vector"]].assign(
        floor=pd.Series(floors, asks.index, object))


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best rows of one block for one group of queries."""
    out = []
    if len(rows) and len(queries):
        rows = rows.sort_values(["unnamed", "id", "number"], ignore_index=True)
        width = max(max(map(len, queries["vector"])), max(map(len, rows["vector"])))
        floors = [None if floor is None else int(floor) for floor in queries["floor"]]
        found = _block(rows, width).top(
            _matrix(queries["vector"], width), queries["number"].to_numpy(np.int64), floors, k)
        named = list(zip(rows["id"], rows["unnamed"], rows["number"]))
        for *query, best in zip(queries["id"], queries["unnamed"], queries["number"], found):
            for score, row in best:
                kept = max(-_LONG - 1, min(_LONG, score))
                out.append((*query, *named[row], kept, _sortable(score)))
    return pd.DataFrame(out, columns=[
        "query_id", "query_unnamed", "query_number", "id", "unnamed", "number", "score", "order"])


def _sortable(score: int) -> str:
    """Text in the order of the numbers, of any that products of vectors reach."""
    shifted = score + (1 << 190)
    return f"{shifted:048x}"


_ASKING = "id long, unnamed boolean, number long, vector array<long>, floor string"
_FOUND = (
    "query_id long, query_unnamed boolean, query_number long, id long, unnamed boolean, number long, score long, "
    "order string"
)


def top_k(vectors: DataFrame, vec_id: str, embedding: str, asks: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best other rows for each row that ``asks``.

    Exact at every size: any pair that may count is scored, unless the threshold rules it out.
    """
    name = F.col(vec_id).cast("long")
    index = _index(vectors.select(
        F.coalesce(name, F.lit(0)).alias("id"), name.isNull().alias("unnamed"),
        F.coalesce(asks, F.lit(False)).alias("asks"), whole_numbers(embedding).alias("vector"),
    ).filter(F.col("vector").isNotNull()))
    asking = stored(index.groupBy("block").applyInPandas(lambda rows: _floors(rows, k), _ASKING), "topk-queries")
    counted = index.agg(F.coalesce(F.max("block"), F.lit(0)).alias("last"), F.count_if("asks").alias("asks")).first()
    groups = max(1, -(-counted.asks // GROUP_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")
    questions = asking.withColumn("group", group).withColumn("block", each(counted.last + 1))
    blocks = index.drop("asks").withColumn("group", each(groups))
    keys = ["block", "group"]
    found = questions.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(
        lambda queries, rows: _best(queries, rows, k), _FOUND)
    order = Window.partitionBy("query_number").orderBy(F.desc("order"), "unnamed", "id", "number")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = lambda key, unnamed: F.when(~F.col(unnamed), F.col(key))
    return ranked.select(
        named("query_id", "query_unnamed").alias("query_id"), "rank", named("id", "unnamed").alias("vec_id"), "score")
