"""Topics whose terms drift from day to day.

Each topic has natural parameters for every day and term; their softmax over the terms are
the topic's weights of that day, and over the days they are a Gaussian random walk.  The
bound of the log probability of documents and walks is raised by turns: documents infer
their topics from the weights of their day, going on from where they were, and then the
walk of each term is fitted to its expected counts.  Neither turn can lower the bound.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiflux.operators.topics import Inference, TopicModel, next_version, side_by_side
from epiflux.session import stored
from epiflux.sources.tables import fixed_table

#: Variance of a walk's first day around the static topic.
FIRST_VARIANCE = 10.0


@dataclass
class DriftingModel:
    """Weights ``(day, topic, term, weight)``, document ``shares`` and the bound after each sweep."""

    weights: DataFrame
    shares: DataFrame
    alpha: float
    bounds: list[float] = field(default_factory=list)


def solve_chains(diagonal: np.ndarray, link: float, right: np.ndarray) -> np.ndarray:
    """Solutions of tridiagonal systems, one a column, by a pass forward and a pass back.

    Off the diagonal all entries are ``-link``.
    """
    days = len(right)
    ahead, value = np.zeros_like(right), np.empty_like(right)
    pivot = diagonal[0]
    value[0] = right[0] / pivot
    for t in range(1, days):
        ahead[t - 1] = -link / pivot
        pivot = diagonal[t] + link * ahead[t - 1]
        value[t] = (right[t] + link * value[t - 1]) / pivot
    for t in range(days - 2, -1, -1):
        value[t] -= ahead[t] * value[t + 1]
    return value


def penalty(walk: np.ndarray, origin: np.ndarray, variance: float) -> np.ndarray:
    """What the random walk's log density falls short of its top, for each column."""
    return (np.diff(walk, axis=0) ** 2).sum(axis=0) / (2 * variance) + (walk[0] - origin) ** 2 / (2 * FIRST_VARIANCE)


def fit_walks(
    walk: np.ndarray, counts: np.ndarray, rate: np.ndarray, origin: np.ndarray, variance: float,
    iterations: int = 50, tolerance: float = 1e-8,
) -> np.ndarray:
    """Walks (days by terms) that maximise ``counts * walk - rate * exp(walk)`` less their penalty.

    The objective is concave.  Newton steps are solved over the days; a step that does not
    raise a term's objective is halved for that term.
    """
    days = len(walk)
    link = 1 / variance
    ends = np.full((days, 1), 2 * link)
    ends[0] = (link if days > 1 else 0) + 1 / FIRST_VARIANCE
    if days > 1:
        ends[-1] = link

    def value(x):
        with np.errstate(over="ignore", invalid="ignore"):
            found = (counts * x - rate * np.exp(x)).sum(axis=0) - penalty(x, origin, variance)
        return np.where(np.isfinite(found), found, -np.inf)

    best = value(walk)
    for _ in range(iterations):
        spread = rate * np.exp(walk)
        slope = counts - spread
        if days > 1:
            steps = np.diff(walk, axis=0) * link
            slope[:-1] += steps
            slope[1:] -= steps
        slope[0] -= (walk[0] - origin) / FIRST_VARIANCE
        move = solve_chains(spread + ends, link, slope)
        if np.abs(move).max(initial=0) < tolerance:
            break
        size = np.ones(walk.shape[1])
        for _ in range(30):
            tried = walk + size * move
            after = value(tried)
            worse = after < best
            if not worse.any():
                break
            size[worse] /= 2
        keep = after >= best
        walk = np.where(keep, tried, walk)
        best = np.where(keep, after, best)
    return walk


_STATE = "day {day}, part int, doc_id {doc}, at int, found array<double>, bound double"


def _parts(vectors: DataFrame, calendar: DataFrame) -> DataFrame:
    """Documents with ``part``: those of a day in groups of bounded size."""
    joined = vectors.join(F.broadcast(calendar.select("day", "parts")), "day")  # a row a day
    return joined.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")


def _infer(docs: DataFrame, walks: DataFrame, calendar: DataFrame, gammas: DataFrame | None, k: int, alpha: float,
           iterations: int, tolerance: float) -> DataFrame:
    """One turn over the documents: a row of topic counts for each, and for each group its expected counts.

    Documents meet the parameters of their day over a shuffle, in groups of bounded size; a
    group holds the capped vocabulary once.
    """
    doc = docs.schema["doc_id"].dataType.simpleString()
    schema = _STATE.format(day=docs.schema["day"].dataType.simpleString(), doc=doc)
    known = walks.join(F.broadcast(calendar.select("day", "parts")), "day").select(
        "day", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "at",
        F.lit(None).cast(doc).alias("doc_id"), F.col("walk").alias("values"))
    if gammas is not None:
        known = known.unionByName(gammas.select(
            "day", "part", F.lit(None).cast("int").alias("at"), "doc_id", F.col("found").alias("values")))

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        walk = known[known["at"].notna()].sort_values("at")
        held = np.exp(np.stack(walk["values"].to_numpy())).T
        weights = held / held.sum(axis=1, keepdims=True)
        before = known[known["at"].isna()].set_index("doc_id")["values"]
        sums, out = np.zeros(weights.shape), []
        for part in side_by_side(rows):
            gamma = None if before.empty else np.stack(before.loc[part["doc_id"]].to_numpy())
            found = Inference(part["at"], part["n"], weights, alpha, iterations, tolerance, gamma)
            sums += found.expected(weights.shape[1])
            out.append(pd.DataFrame({"doc_id": part["doc_id"], "found": list(found.gamma), "bound": found.bound()}))
        used = np.nonzero(sums.any(axis=0))[0]
        out.append(pd.DataFrame({"at": pd.array(used, "Int32"), "found": list(sums[:, used].T)}))
        both = pd.concat(out, ignore_index=True) if len(rows) else out[-1].assign(doc_id=None, bound=None)
        return both.assign(day=known["day"].iloc[0], part=known["part"].iloc[0])[
            ["day", "part", "doc_id", "at", "found", "bound"]]

    keys = ["day", "part"]
    return stored(docs.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(run, schema), "drifting-state")


def _refit(walks: DataFrame, counts: DataFrame, order: list, rate: np.ndarray, origin: np.ndarray, variance: float,
           buckets: int) -> DataFrame:
    """Walks of all topics and terms, fitted to ``counts`` (``day, at, n``); a group is a slice of the vocabulary."""
    k = len(origin)
    days = len(order)
    place = {day: at for at, day in enumerate(order)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(place=rows["day"].map(place)).sort_values(["at", "place"])
        at = rows["at"].to_numpy()[::days]
        shape = (len(at), days, k)
        walk, n = (np.stack(rows[c].to_numpy()).reshape(shape).transpose(1, 0, 2).reshape(days, -1) for c in ("walk", "n"))
        start = origin[:, at].T.ravel()
        new = fit_walks(walk, n, np.tile(rate, len(at)), start, variance)
        lost = penalty(new, start, variance).reshape(len(at), k).sum(axis=1)
        cells = new.reshape(days, len(at), k).transpose(1, 0, 2).reshape(-1, k)
        return pd.DataFrame({
            "day": rows["day"].to_numpy(), "at": rows["at"].to_numpy(), "walk": list(cells),
            "penalty": np.where(rows["place"] == 0, np.repeat(lost, days), 0.0),
        })

    none = F.array(*[F.lit(0.0)] * k)
    keyed = walks.drop("penalty").join(counts, ["day", "at"], "left").withColumns({
        "n": F.coalesce("n", none), "bucket": F.col("at") % buckets})
    schema = ", ".join(f"{c} {walks.schema[c].dataType.simpleString()}" for c in ("day", "at", "walk", "penalty"))
    return stored(keyed.groupBy("bucket").applyInPandas(run, schema), "drifting-walks")


def _start_walks(spark: SparkSession, origin: np.ndarray, calendar: DataFrame) -> DataFrame:
    rows = [(at, origin[:, at].tolist()) for at in range(origin.shape[1])]  # the capped vocabulary
    terms = fixed_table(spark, rows, "at int, walk array<double>")
    every = calendar.agg(F.collect_list("day").alias("days"))  # a value a day
    days = F.explode(F.lit(every.first().days))
    return stored(terms.select(days.alias("day"), "at", "walk", F.lit(0.0).alias("penalty")), "drifting-walks")


def _summed(state: DataFrame, k: int) -> DataFrame:
    totals = F.array(*[F.sum(F.col("found")[topic]) for topic in range(k)])
    return state.filter(F.col("at").isNotNull()).groupBy("day", "at").agg(totals.alias("n"))


def fit_drifting_topics(
    start: TopicModel, day: str, doc_id: str = "doc_id", chain_variance: float = 0.05, sweeps: int = 10,
    tolerance: float = 1e-4, iterations: int = 20, group_docs: int = 2_000, buckets: int = 32,
) -> DriftingModel:
    """Fit drifting topics from a static model, over the documents that it was fitted on.

    A sweep is a turn over the documents and one over the walks; sweeps end when the bound
    rises by less than ``tolerance`` of itself, or after ``sweeps``.  Every sweep reads every
    document.  Days are those of the documents; a term that a day does not have is carried
    by its neighbours.
    """
    k, alpha = start.k, start.alpha
    origin = np.log(start.counts / start.counts.sum(axis=1, keepdims=True))
    vectors = start.vectors.select(F.col(doc_id).alias("doc_id"), F.col(day).alias("day"), "at", "n").filter("day IS NOT NULL")
    calendar = vectors.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / group_docs).cast("int").alias("parts"))
    calendar = stored(calendar, "drifting-days")
    order = [row.day for row in calendar.orderBy("day").collect()]  # a value a day
    docs = stored(_parts(vectors, calendar), "drifting-documents")
    walks = _start_walks(docs.sparkSession, origin, calendar)
    gammas, bounds, state = None, [], None
    while True:
        state = _infer(docs, walks, calendar, gammas, k, alpha, iterations, 1e-3)
        bounds.append((state.agg(F.sum("bound")).first()[0] or 0.0) - walks.agg(F.sum("penalty")).first()[0])
        gammas = state.filter(F.col("at").isNull())
        rise = bounds[-1] - bounds[-2] if len(bounds) > 1 else np.inf
        if len(bounds) > sweeps or rise <= tolerance * abs(bounds[-1]):
            break
        counts = stored(_summed(state, k), "drifting-counts")
        norms = [F.sum(F.exp(F.col("walk")[topic])) for topic in range(k)]
        used = [F.sum(F.col("n")[topic]) for topic in range(k)]
        zeta = {row.day: row.v for row in walks.groupBy("day").agg(F.array(*norms).alias("v")).collect()}
        total = {row.day: row.v for row in counts.groupBy("day").agg(F.array(*used).alias("v")).collect()}
        rate = np.array([np.divide(total.get(at, [0.0] * k), zeta[at]) for at in order])
        walks = _refit(walks, counts, order, rate, origin, chain_variance, buckets)
    return DriftingModel(day_weights(walks, start.terms), _shares(gammas), alpha, bounds)


def day_weights(walks: DataFrame, terms: list[str]) -> DataFrame:
    """``(day, topic, term, weight)``, with weights that add up to 1 for each day and topic."""
    listed = fixed_table(walks.sparkSession, enumerate(terms), "at int, term string")
    cells = walks.join(F.broadcast(listed), "at").select("day", "term", F.posexplode("walk").alias("topic", "value"))
    sums = cells.groupBy("day", "topic").agg(F.sum(F.exp("value")).alias("sum"))
    return cells.join(sums, ["day", "topic"]).select(
        "day", "topic", "term", (F.exp("value") / F.col("sum")).alias("weight"))


def _shares(gammas: DataFrame) -> DataFrame:
    total = F.aggregate("found", F.lit(0.0), lambda acc, x: acc + x)
    return gammas.select("doc_id", "day", F.transform("found", lambda x: x / total).alias("shares"))


# ---------------------------------------------------------------- stored models


def save_drifting(model: DriftingModel, path: str) -> int:
    """Write the weights with their vocabulary and day axis as the next version below ``path``; returns the version."""
    version = next_version(model.weights.sparkSession, path)
    cells = F.sort_array(F.collect_list(F.struct("topic", "weight")))
    rows = model.weights.groupBy("day", "term").agg(F.transform(cells, lambda x: x["weight"]).alias("weights"))
    rows.withColumn("alpha", F.lit(model.alpha)).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def load_drifting(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``day, term, weights, alpha`` of a version, the last one unless it is named."""
    version = next_version(spark, path) - 1 if version is None else version
    return spark.read.parquet(f"{path}/version={version}")


def score_on_days(
    stored_model: DataFrame, counts: DataFrame, docs: DataFrame, iterations: int = 100, group_docs: int = 2_000
) -> DataFrame:
    """``doc_id, day, shares`` of documents (``doc_id, day``) by the stored weights of their day.

    ``counts`` is ``(doc_id, term, n)``.  A document of a day that the model does not have is
    scored by the last day before it, or else by the first.
    """
    known = [row.day for row in stored_model.select("day").distinct().orderBy("day").collect()]  # a value a day
    row = stored_model.select("alpha", F.size("weights").alias("k")).first()
    names = [r.term for r in stored_model.select("term").distinct().orderBy("term").collect()]  # the vocabulary cap
    listed = fixed_table(docs.sparkSession, enumerate(names), "at int, term string")
    days = F.array(*[F.lit(day) for day in known])
    earlier = F.filter(days, lambda day: day <= F.col("day"))
    model_day = F.coalesce(F.try_element_at(earlier, F.lit(-1)), F.element_at(days, 1))
    cells = counts.join(F.broadcast(listed), "term").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("cells"))
    vectors = docs.select("doc_id", F.col("day").alias("own"), model_day.alias("day")).join(cells, "doc_id", "left").select(
        "doc_id", "own", "day", F.coalesce("cells.at", F.array().cast("array<int>")).alias("at"),
        F.coalesce("cells.n", F.array().cast("array<bigint>")).alias("n"))
    vectors = stored(vectors, "scored-documents")
    calendar = stored(
        vectors.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / group_docs).cast("int").alias("parts")), "scored-days")
    walks = stored_model.join(F.broadcast(listed), "term").join(calendar.select("day"), "day", "left_semi").select(
        "day", "at", F.transform("weights", lambda x: F.log(x)).alias("walk"))
    state = _infer(_parts(vectors.drop("own"), calendar), walks, calendar, None, row.k, row.alpha, iterations, 1e-3)
    found = _shares(state.filter(F.col("at").isNull())).drop("day")
    return vectors.select("doc_id", F.col("own").alias("day")).join(found, "doc_id")


# ---------------------------------------------------------------- tables read from drifting topics


def top_terms_by_day(weights: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` heaviest terms per day and topic, ranked from 0."""
    order = Window.partitionBy("day", "topic").orderBy(F.desc("weight"), "term")
    ranked = weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.withColumn("rank", F.col("rank") - 1)


def topic_evolution(weights: DataFrame, topic: int, days: list, n: int = 20) -> DataFrame:
    """Top terms of one topic: a row per rank, a column per day."""
    ranked = top_terms_by_day(weights.filter(F.col("topic") == topic), n)
    labels = [str(day) for day in days]
    dated = ranked.withColumn("day", F.col("day").cast("string"))
    return dated.groupBy("rank").pivot("day", labels).agg(F.max("term"))
