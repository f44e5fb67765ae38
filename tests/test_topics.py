"""Topic models: inference against plain formulas, online steps, drift, coherence and stored models."""

import datetime
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiflux.operators import drifting, topics, vectorize
from epiflux.operators.topics import Inference, TopicModel


def day(n):
    return datetime.date(2024, 1, n)


def plain_gamma(at, n, weights, alpha, iterations, tolerance=1e-3):
    """One document by the textbook's loop."""
    gamma = np.full(len(weights), alpha + sum(n) / len(weights))
    for _ in range(iterations if len(at) else 0):
        theta = topics.expected_log(gamma)
        new = np.full(len(weights), alpha)
        for term, times in zip(at, n):
            phi = theta * weights[:, term]
            new += times * phi / phi.sum()
        change = np.abs(new - gamma).mean()
        gamma = new
        if change < tolerance:
            break
    return gamma


def documents(rng, n, terms):
    at = [sorted(rng.sample(range(terms), rng.randint(0, terms // 2))) for _ in range(n)]
    return at, [[rng.randint(1, 4) for _ in doc] for doc in at]


def test_digamma_is_the_derivative_of_log_gamma():
    for x in (0.01, 0.5, 1, 3.7, 40, 1e5):
        step = 1e-5 * x
        slope = (math.lgamma(x + step) - math.lgamma(x - step)) / (2 * step)
        assert abs(topics.digamma(x) - slope) < 1e-6 * max(1, abs(slope))
        assert abs(topics.log_gamma(x) - math.lgamma(x)) < 1e-9 * max(1, abs(math.lgamma(x)))


def test_inference_side_by_side_equals_one_by_one():
    rng = random.Random(4)
    weights = np.random.default_rng(1).dirichlet(np.ones(20), 3)
    at, n = documents(rng, 40, 20)
    found = Inference(at, n, weights, 0.1, iterations=50)
    for i in range(40):
        assert np.allclose(found.gamma[i], plain_gamma(at[i], n[i], weights, 0.1, 50))
    assert np.allclose(found.expected(20).sum(axis=0), np.bincount(np.concatenate(at).astype(int), np.concatenate(n), 20))


def test_inference_holds_the_weights_of_terms_once():
    topics_, cells = 20, 40 * 500
    weights = np.random.default_rng(3).dirichlet(np.ones(500), topics_)
    at, n = [np.arange(500)] * 40, [np.ones(500)] * 40
    tracemalloc.start()
    Inference(at, n, weights, 0.1, iterations=3, tolerance=0).expected(500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * topics_ * cells * 8


def test_more_iterations_never_lower_the_bound():
    rng = random.Random(5)
    weights = np.random.default_rng(2).dirichlet(np.ones(15), 4)
    at, n = documents(rng, 30, 15)
    found = Inference(at, n, weights, 0.05, iterations=1, tolerance=0)
    for _ in range(20):
        more = Inference(at, n, weights, 0.05, iterations=1, tolerance=0, gamma=found.gamma)
        assert (more.bound() >= found.bound() - 1e-9).all()
        found = more


@pytest.mark.parametrize("chunk", [1000, 20])
def test_fit_finds_planted_topics_in_any_order(spark, chunk):
    rows = [(i, [f"{'ab'[i % 2]}{j}" for j in range(i % 5, i % 5 + 6)]) for i in range(120)] + [(999, [])]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>").withColumn("day", F.lit(1))
    fitted = topics.fit_topics(docs, "doc_id", "terms", k=2, passes=4, chunk=chunk, min_df=2)
    again = topics.fit_topics(docs.repartition(5), "doc_id", "terms", k=2, passes=4, chunk=chunk, min_df=2)
    assert fitted.terms == again.terms and np.allclose(fitted.counts, again.counts)
    shares = {r.doc_id: r.shares for r in topics.doc_topics(fitted, ["doc_id"]).collect()}
    assert len(shares) == 121 and shares[999] == [0.5, 0.5]
    side = shares[0].index(max(shares[0]))
    assert all((max(shares[i]) > 0.9) and (shares[i][side] > 0.5) == (i % 2 == 0) for i in range(120))
    if chunk == 1000:  # a batch of all documents: all counts are in the model, and the prior
        assert abs(fitted.counts.sum() - 120 * 6 - 0.5 * fitted.counts.size) < 1e-6


def test_step_sizes_and_scale(spark):
    vectors = spark.createDataFrame([(0, [0, 1], [2, 1]), (1, [1], [3])], "doc_id int, at array<int>, n array<int>")
    lam = np.array([[3.0, 1.0], [1.0, 2.0]])
    sums = topics.expected_counts(vectors, lam, 0.1, 10)
    assert abs(sums.sum() - 6) < 1e-9
    got = topics.online_step(lam, vectors, 0.25, 8, 0.1, 0.5, decay=0.7, offset=2.0, iterations=10)
    rate = 10 ** -0.7
    assert np.allclose(got, (1 - rate) * lam + rate * (0.5 + 4 * sums))


def test_batches_are_dealt_by_digest(spark):
    rows = spark.range(4000).select(topics.batch_of("id", 4).alias("b")).groupBy("b").count().collect()
    assert len(rows) == 4 and all(900 < row["count"] < 1100 for row in rows)


# ---- drift


def test_chains_are_solved():
    rng = np.random.default_rng(3)
    diagonal, right = rng.uniform(5, 9, (6, 4)), rng.normal(size=(6, 4))
    got = drifting.solve_chains(diagonal, 2.0, right)
    for c in range(4):
        full = np.diag(diagonal[:, c]) - 2 * (np.eye(6, k=1) + np.eye(6, k=-1))
        assert np.allclose(full @ got[:, c], right[:, c])
    assert np.allclose(drifting.solve_chains(diagonal[:1], 2.0, right[:1]), right[:1] / diagonal[:1])


@pytest.mark.parametrize("days", [1, 2, 7])
def test_walks_are_at_the_top(days):
    rng = np.random.default_rng(days)
    counts = rng.poisson(3, (days, 5)).astype(float)
    counts[:, 0] = 0
    rate, origin = rng.uniform(0.5, 40, (days, 5)), rng.normal(size=5)
    start = np.tile(origin, (days, 1)) + 3
    value = lambda x: (counts * x - rate * np.exp(x)).sum(axis=0) - drifting.penalty(x, origin, 0.05)
    walk = drifting.fit_walks(start, counts, rate, origin, 0.05)
    assert (value(walk) >= value(start)).all()
    for _ in range(200):
        assert (value(walk + rng.normal(0, 0.01, walk.shape)) <= value(walk) + 1e-9).all()


def drifting_corpus(spark):
    """A topic whose word moves from 'old' to 'new' over six days, and one that stays."""
    rng = random.Random(8)
    rows = []
    for i in range(360):
        today = i % 6
        if i % 2:
            words = [rng.choice(["old", "new"]) if rng.random() < 0.3 else ("new" if rng.random() < today / 5 else "old")
                     for _ in range(8)] + ["virus"] * 2
        else:
            words = [rng.choice(["home", "work", "shop"]) for _ in range(10)]
        rows.append((i, day(1 + today), words))
    return spark.createDataFrame([*rows, (999, day(3), [])], "doc_id long, day date, terms array<string>")


def test_planted_drift_is_found_and_the_bound_rises(spark):
    docs = drifting_corpus(spark)
    start = topics.fit_topics(docs, "doc_id", "terms", k=2, passes=4, chunk=90, min_df=2)
    model = drifting.fit_drifting_topics(start, "day", chain_variance=0.2, sweeps=6, tolerance=0.0, group_docs=25, buckets=3)
    assert len(model.bounds) > 3
    assert all(b >= a - 1e-7 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    weights = {(r.day, r.topic, r.term): r.weight for r in model.weights.collect()}
    sums = model.weights.groupBy("day", "topic").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 12 and all(abs(r.w - 1) < 1e-9 for r in sums)
    moving = max((0, 1), key=lambda k: weights[day(1), k, "old"])
    rise = [weights[day(d), moving, "new"] for d in range(1, 7)]
    assert all(b > a - 0.02 for a, b in zip(rise, rise[1:])) and rise[0] < 0.25 and rise[-1] > 0.5
    still = [weights[day(d), 1 - moving, "home"] for d in range(1, 7)]
    assert max(still) - min(still) < 0.15
    shares = {r.doc_id: r.shares for r in model.shares.collect()}
    assert len(shares) == 361 and shares[999] == [0.5, 0.5]
    assert all((shares[i][moving] > 0.8) == bool(i % 2) for i in range(360))


def test_a_sweep_by_plain_formulas(spark):
    """Expected counts and bound of the first turn, whatever the grouping."""
    docs = drifting_corpus(spark)
    start = topics.fit_topics(docs, "doc_id", "terms", k=2, passes=1, min_df=2)
    one, many = (drifting.fit_drifting_topics(start, "day", sweeps=0, iterations=500, group_docs=g) for g in (10_000, 7))
    weights = start.counts / start.counts.sum(axis=1, keepdims=True)
    found = {r.doc_id: np.array(r.shares) for r in many.shares.collect()}
    total = 0.0
    for r in start.vectors.collect():
        gamma = plain_gamma(r["at"], r["n"], weights, 0.01, 500)
        assert np.allclose(found[r.doc_id], gamma / gamma.sum())
        total += Inference([r["at"]], [r["n"]], weights, 0.01, 500).bound()[0]
    assert abs(one.bounds[0] - total) < 1e-6 * abs(total) and abs(many.bounds[0] - total) < 1e-6 * abs(total)


# ---- stored models


def test_versions_of_a_static_model(spark, tmp_path):
    path = f"{tmp_path}/model"
    docs = drifting_corpus(spark)
    fitted = topics.fit_topics(docs, "doc_id", "terms", k=2, passes=2, min_df=2)
    assert topics.save_topics(fitted, spark, path) == 1
    changed = TopicModel(fitted.counts + 1, fitted.terms, fitted.alpha)
    assert topics.save_topics(changed, spark, path) == 2
    again = topics.load_topics(spark, path, fitted.vectors, version=1)
    assert again.terms == fitted.terms and (again.counts == fitted.counts).all()
    assert (topics.load_topics(spark, path).counts == changed.counts).all()
    before = topics.doc_topics(fitted, ["doc_id"]).orderBy("doc_id").collect()
    assert topics.score_documents(again, docs, "doc_id", "terms").select("doc_id", "shares").orderBy("doc_id").collect() == before
    unseen = spark.createDataFrame([(5, ["unknown"]), (6, ["home", "work"])], "doc_id long, terms array<string>")
    scored = {r.doc_id: r.shares for r in topics.score_documents(again, unseen, "doc_id", "terms").collect()}
    assert scored[5] == [0.5, 0.5] and max(scored[6]) > 0.8


def test_a_stored_drifting_model_scores_as_before(spark, tmp_path):
    docs = drifting_corpus(spark)
    start = topics.fit_topics(docs, "doc_id", "terms", k=2, passes=2, min_df=2)
    model = drifting.fit_drifting_topics(start, "day", sweeps=8, iterations=300)
    assert drifting.save_drifting(model, f"{tmp_path}/model") == 1
    loaded = drifting.load_drifting(spark, f"{tmp_path}/model")
    counts = vectorize.term_counts(docs, "doc_id", "terms")
    scored = drifting.score_on_days(loaded, counts, docs.select("doc_id", "day"), iterations=300)
    before = {r.doc_id: r.shares for r in model.shares.collect()}
    after = {r.doc_id: (r.day, r.shares) for r in scored.collect()}
    assert len(after) == 361
    assert all(np.allclose(before[i], after[i][1], atol=0.02) for i in before)
    late = spark.createDataFrame([(1, day(9), ["new"] * 5), (2, day(1), ["home"] * 5)], "doc_id long, day date, terms array<string>")
    far = drifting.score_on_days(loaded, vectorize.term_counts(late, "doc_id", "terms"), late.select("doc_id", "day"))
    assert {r.doc_id: (r.day, max(r.shares) > 0.8) for r in far.collect()} == {1: (day(9), True), 2: (day(1), True)}


# ---- coherence


def test_umass_by_hand(spark):
    vectors = spark.createDataFrame(
        [(0, [0, 1]), (1, [0]), (2, [0, 1]), (3, [2]), (4, [])], "doc_id int, at array<int>").repartition(3)
    listed = spark.createDataFrame(
        [(7, 0, "a"), (7, 1, "b"), (7, 2, "c"), (8, 0, "b"), (8, 1, "a"), (9, 0, "nowhere"), (9, 1, "a"), (6, 0, "a")],
        "topic int, rank int, term string")
    found = topics.umass_coherence(vectors, ["a", "b", "c"], listed, ["topic"]).collect()
    got = {r.topic: r.coherence for r in found}
    ratio = lambda both, base: math.log((both / 5 + 1e-12) / (base / 5))
    assert abs(got[7] - np.mean([ratio(2, 3), ratio(0, 3), ratio(0, 2)])) < 1e-9
    assert abs(got[8] - ratio(2, 2)) < 1e-9 and got[9] == 0.0 and set(got) == {7, 8, 9}
