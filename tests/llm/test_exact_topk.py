"""Top-k search against all products."""

import math
import random

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from epiflux.llm import exact_topk, queries

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k):
    limit = 2**63 - 1
    whole = lambda x: max(-limit - 1, min(limit, math.floor(256 * x)))
    known = [(i, key, [whole(x) for x in v]) for i, (key, v) in enumerate(rows)
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, q in known:
        if key is None or key % 3:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), other is None, other or 0, other) for j, other, v in known if j != i]
        for rank, (score, _, _, other) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out.append((key, rank, other, max(-limit - 1, min(limit, -score))))
    return sorted(out, key=repr)


def run(spark, rows, k):
    frame = spark.createDataFrame([(*row, 7, "x") for row in rows], SCHEMA + ", block int, number string")
    return sorted(map(tuple, exact_topk.top_k(frame, "vec_id", "embedding", F.col("vec_id") % 3 == 0, k).collect()), key=repr)


@pytest.mark.parametrize("block, group, spread", [(8192, 2048, 1.0), (40, 7, 0.02), (25, 1000, 1.0)])
def test_same_as_all_products(spark, monkeypatch, block, group, spread):
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(exact_topk, "GROUP_QUERIES", group)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, spread) for _ in range(6)]) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(60)]  # many equal rows: ties go to the smaller id
    rows += [(300, None), (303, [None, 1.0]), (306, [float("nan")]), (309, [float("inf")]), (312, []), (315, [0.5]),
             (None, rows[0][1]), (0, rows[1][1]), (318, [0.0] * 8)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_products_beyond_doubles(spark):
    rows = [(i, [3e12 + i, 1e13 - 7 * i, -2e12]) for i in range(0, 30)] + [(99, [1e30, -1e30, 1.0]), (102, [1e17, 1.0, 2.0])]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_few_rows(spark):
    assert run(spark, [(3, [1.0])], 5) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])], 5) == []
    assert run(spark, [(3, [1.0]), (2, [2.0])], 5) == [(3, 1, 2, 256 * 512)]
    assert exact_topk.top_k(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", F.lit(True)).collect() == []


def test_search_stops_at_the_threshold():
    rng = np.random.default_rng(2)
    values = rng.integers(-5, 5, (4000, 4))
    values[17] = 900
    block = exact_topk.SortedLists(np.arange(4000), values)
    read = []

    class Order(np.ndarray):
        def __getitem__(self, key):
            read.append(key[0])
            return super().__getitem__(key)

    block.order = block.order.view(Order)
    assert block.top(np.array([[1, 2, 1, 1]]), np.array([-1]), [None], 1) == [[(4500, 17)]]
    assert all(part.stop == 4000 and part.start == 4000 - exact_topk.FIRST_DEPTH for part in read[::2]) and len(read) == 2


def test_query_matches_its_sql(spark, folder):
    name = "op13_exact_topk"
    rows, problems = compare(spark, folder, name, queries.QUERIES[name], queries.ORACLES[name])
    assert rows > 0 and not problems, problems
