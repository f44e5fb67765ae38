"""Topic models of messages and the tables read from them; ``drifting`` has those that change over time."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiflux.operators.vectorize import ngram_vectors, ngram_vocabulary, term_counts, vocabulary
from epiflux.session import stored
from epiflux.sources.files import list_names
from epiflux.sources.tables import fixed_table

#: Documents whose topics are inferred side by side.
_SIDE_BY_SIDE = 500


@dataclass
class TopicModel:
    """A fitted static model: pseudo-counts of terms per topic, the vocabulary, and the documents it was fitted on."""

    counts: np.ndarray  # topics by terms; terms are at most the vocabulary cap
    terms: list[str]
    alpha: float
    vectors: DataFrame | None = None

    @property
    def k(self) -> int:
        return len(self.counts)


def digamma(x) -> np.ndarray:
    """Six steps of the recurrence, then the asymptotic series."""
    x = np.asarray(x, float)
    far = x + 6
    square = 1 / (far * far)
    series = np.log(far) - 0.5 / far - square * (1 / 12 - square * (1 / 120 - square / 252))
    return series - sum(1 / (x + step) for step in range(6))


def expected_log(counts: np.ndarray) -> np.ndarray:
    """Exponential of the expected log weights of Dirichlet rows."""
    return np.exp(digamma(counts) - digamma(counts.sum(axis=-1, keepdims=True)))


def log_gamma(x) -> np.ndarray:
    """Six steps of the recurrence, then Stirling's series."""
    x = np.asarray(x, float)
    far = x + 6
    square = 1 / (far * far)
    series = (far - 0.5) * np.log(far) - far + 0.5 * math.log(2 * math.pi)
    series += (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680))) / far
    return series - sum(np.log(x + step) for step in range(6))


class Inference:
    """Topic pseudo-counts ``gamma`` of documents, from the weights of the topics.

    All documents are iterated on together, as arrays over their terms; a document stops
    when its own pseudo-counts change by less than ``tolerance`` on average, so what it gets
    does not depend on its neighbours.  With ``gamma`` the search goes on from there, and
    never lowers the bound.
    """

    def __init__(self, at, n, weights: np.ndarray, alpha: float, iterations: int = 100, tolerance: float = 1e-3, gamma=None):
        self.alpha, topics = alpha, len(weights)
        sizes = np.array([len(x) for x in at], int)
        self.at = np.concatenate([np.zeros(0, int), *[np.asarray(x, int) for x in at]])
        self.n = np.concatenate([np.zeros(0), *[np.asarray(x, float) for x in n]])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.beta = weights[:, self.at]
        if gamma is None:
            gamma = alpha + np.tile(np.bincount(self.doc, self.n, len(sizes))[:, None] / topics, topics)
        self.gamma = np.array(gamma, float).reshape(len(sizes), topics)
        self._iterate(sizes, iterations, tolerance)
        # of the terms: the share of each topic, up to the norm
        self.theta = expected_log(self.gamma).T if len(sizes) else np.zeros((topics, 0))
        self.norm = self._norms(self.theta.T, self.beta, sizes)

    @staticmethod
    def _norms(theta, beta, held) -> np.ndarray:
        """Sums over the topics, one topic at a time over all terms in a row; ``held`` are the terms of each document."""
        norms = np.full(held.sum(), 1e-100)
        for topic, weights in enumerate(beta):
            part = np.repeat(theta[:, topic], held)
            part *= weights
            norms += part
        return norms

    def _iterate(self, sizes, iterations, tolerance) -> None:
        live = np.flatnonzero(sizes)
        beta, n, held = list(self.beta), self.n, sizes[live]
        moving = np.ones(len(live), bool)
        for _ in range(iterations if len(live) else 0):
            theta = expected_log(self.gamma[live])
            ratio = n / self._norms(theta, beta, held)
            starts = np.concatenate([[0], np.cumsum(held)[:-1]])
            new = self.alpha + theta * np.stack([np.add.reduceat(weights * ratio, starts) for weights in beta], 1)
            change = np.abs(new - self.gamma[live]).mean(axis=1)
            self.gamma[live[moving]] = new[moving]
            moving &= change >= tolerance
            if not moving.any():
                return
            if moving.mean() < 0.7:
                cells = np.repeat(moving, held)
                live, n, held = live[moving], n[cells], held[moving]
                beta = [weights[cells] for weights in beta]
                moving = np.ones(len(live), bool)

    def expected(self, terms: int) -> np.ndarray:
        """Expected counts, topics by terms."""
        ratio = self.n / self.norm
        return np.array([np.bincount(self.at, theta[self.doc] * beta * ratio, terms) for theta, beta in zip(self.theta, self.beta)])

    def bound(self) -> np.ndarray:
        """Lower bound of each document's log probability, given the weights."""
        gamma, alpha = self.gamma, self.alpha
        topics = gamma.shape[1]
        words = np.bincount(self.doc, self.n * np.log(self.norm), len(gamma))
        theta = ((alpha - gamma) * np.log(self.theta.T) + log_gamma(gamma) - math.lgamma(alpha)).sum(axis=1)
        return words + theta + math.lgamma(topics * alpha) - log_gamma(gamma.sum(axis=1))


def side_by_side(rows: pd.DataFrame):
    """A batch of rows in parts of bounded size."""
    for begin in range(0, len(rows), _SIDE_BY_SIDE):
        yield rows.iloc[begin:begin + _SIDE_BY_SIDE]


def term_vectors(counts: DataFrame, names: list[str], id_columns: list[str]) -> DataFrame:
    """``id_columns, at, n``: term indexes in ``names`` and counts of each document that has any of the terms.

    A document's arrays are bounded by its own distinct terms; the names are as many as the
    vocabulary cap.
    """
    listed = fixed_table(counts.sparkSession, enumerate(names), "at int, term string")
    cells = counts.join(F.broadcast(listed), "term").groupBy(*id_columns).agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("cells"))
    return cells.select(*id_columns, F.col("cells.at").alias("at"), F.col("cells.n").alias("n"))


def _of_words(docs: DataFrame, terms: str) -> bool:
    return docs.schema[terms].dataType.simpleString() == "string"


def document_vectors(docs: DataFrame, doc_id: str, terms: str, names: list[str], counts: DataFrame | None = None) -> DataFrame:
    """The documents with ``at, n``; those without terms of the vocabulary have empty arrays.

    ``terms`` is an array, or a text of words whose bigrams are terms too.
    """
    if counts is None and _of_words(docs, terms):
        return ngram_vectors(docs, terms, names)
    keep = [name for name in docs.columns if name != terms]
    counts = term_counts(docs, doc_id, terms) if counts is None else counts
    return docs.select(*keep).join(term_vectors(counts, names, [doc_id]), doc_id, "left").withColumns({
        "at": F.coalesce("at", F.array().cast("array<int>")), "n": F.coalesce("n", F.array().cast("array<bigint>")),
    })


def frequent_terms(vocab: DataFrame) -> list[str]:
    """The vocabulary in column order: most frequent term first, ties in term order."""
    names = [row.term for row in vocab.orderBy(F.desc("total"), "term").collect()]
    if not names:
        raise ValueError("no term is frequent enough for the vocabulary")
    return names


def expected_counts(vectors: DataFrame, lam: np.ndarray, alpha: float, iterations: int) -> np.ndarray:
    """Expected counts of the topics over documents, inferred where they are.

    A partition hands on its sums, which are as long as the capped vocabulary.
    """
    weights = expected_log(lam)

    def run(batches):
        sums = np.zeros(weights.shape)
        for batch in batches:
            for rows in side_by_side(batch):
                sums += Inference(rows["at"], rows["n"], weights, alpha, iterations).expected(weights.shape[1])
        used = np.nonzero(sums.any(axis=0))[0]
        if len(used):
            yield pd.DataFrame({"at": used.astype("int32"), "sums": list(sums[:, used].T)})

    totals = vectors.select("at", "n").mapInPandas(run, "at int, sums array<double>")
    cells = [F.sum(F.col("sums")[topic]).alias(str(topic)) for topic in range(len(lam))]
    found = np.zeros(lam.shape)
    for row in totals.groupBy("at").agg(*cells).collect():  # at most the vocabulary cap
        found[:, row["at"]] = [row[str(topic)] for topic in range(len(lam))]
    return found


def online_step(
    lam: np.ndarray, batch: DataFrame, share: float, step: int, alpha: float, eta: float,
    decay: float = 0.5, offset: float = 1.0, iterations: int = 100,
) -> np.ndarray:
    """One natural-gradient step from ``lam`` by a mini-batch that holds ``share`` of all documents.

    The step has size ``(offset + step) ** -decay`` and goes towards the pseudo-counts that
    all documents would give if they were like those of the batch.
    """
    rate = (offset + step) ** -decay
    return (1 - rate) * lam + rate * (eta + expected_counts(batch, lam, alpha, iterations) / share)


def batch_of(doc_id: str, batches: int) -> Column:
    """Mini-batch of a document, by the digest of its id: the same in every run."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % batches).cast("int")


def fit_topics(
    docs: DataFrame, doc_id: str, terms: str, k: int = 3, alpha: float = 0.01, eta: float | None = None,
    passes: int = 2, chunk: int | None = None, decay: float = 0.5, offset: float = 1.0, iterations: int = 100,
    seed: int = 0, min_df: int = 10, max_df: float = 0.9, max_terms: int = 10_000, counts: DataFrame | None = None,
) -> TopicModel:
    """Online variational LDA over the count vectors of an array column, or of a text of words and their bigrams.

    Documents are dealt into mini-batches of about ``chunk`` by a digest of their id (a
    quarter of the documents if not given); a batch lies in files of its own.  Every pass
    makes a step with each batch, so every document is read once in every pass, at any size.
    Terms of an array are counted once, into a written table; ``counts`` (``doc_id, term, n``)
    may be handed in where it exists already.
    """
    if counts is None and _of_words(docs, terms):
        names = frequent_terms(ngram_vocabulary(docs, terms, min_df, max_df, max_terms))
    else:
        if counts is None:
            counts = stored(term_counts(docs, doc_id, terms), "topic-counts")
        names = frequent_terms(vocabulary(counts, docs.agg(F.count(F.lit(1))), min_df, max_df, max_terms))
    n_docs = docs.count()
    batches = 4 if chunk is None else max(1, round(n_docs / chunk))
    vectors = document_vectors(docs, doc_id, terms, names, counts)
    vectors = stored(vectors.withColumn("_batch", batch_of(doc_id, batches)), "topic-vectors", by="_batch")
    sizes = {row["_batch"]: row["n"] for row in vectors.groupBy("_batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = 1 / k if eta is None else eta
    lam = np.random.default_rng(seed).gamma(100.0, 0.01, (k, len(names)))
    step = 0
    for _ in range(passes):
        for at in sorted(sizes):
            batch = vectors.filter(F.col("_batch") == at)
            lam = online_step(lam, batch, sizes[at] / n_docs, step, alpha, prior, decay, offset, iterations)
            step += 1
    return TopicModel(lam, names, alpha, vectors.drop("_batch"))


# ---------------------------------------------------------------- stored models


def next_version(spark: SparkSession, path: str) -> int:
    """The version after the last one written below ``path``."""
    names = [name for name in list_names(spark, path) if name.startswith("version=")]
    return 1 + max([0, *[int(name.removeprefix("version=")) for name in names]])


def save_topics(fitted: TopicModel, spark: SparkSession, path: str) -> int:
    """Write a model with its vocabulary as the next version below ``path``, and return the version."""
    version = next_version(spark, path)
    rows = [(at, term, fitted.counts[:, at].tolist(), fitted.alpha) for at, term in enumerate(fitted.terms)]
    table = spark.createDataFrame(rows, "at int, term string, counts array<double>, alpha double")
    table.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def load_topics(spark: SparkSession, path: str, vectors: DataFrame | None = None, version: int | None = None) -> TopicModel:
    """A model written by ``save_topics``, the last one unless a version is named; it has as many rows as the vocabulary."""
    version = next_version(spark, path) - 1 if version is None else version
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("at").collect()
    return TopicModel(np.array([row.counts for row in rows]).T, [row.term for row in rows], rows[0].alpha, vectors)


def _shares(fitted: TopicModel, iterations: int, tolerance: float):
    """The topic distributions, a row each, of documents given as lists of term indexes and counts."""
    weights, alpha = expected_log(fitted.counts), fitted.alpha

    def shares(at, n) -> np.ndarray:
        found = [np.zeros((0, len(weights)))]
        for begin in range(0, len(at), _SIDE_BY_SIDE):
            part = slice(begin, begin + _SIDE_BY_SIDE)
            gamma = Inference(at[part], n[part], weights, alpha, iterations, tolerance).gamma
            found.append(gamma / gamma.sum(axis=1, keepdims=True))
        return np.concatenate(found)

    return shares


def score_documents(
    fitted: TopicModel, docs: DataFrame, doc_id: str, terms: str, iterations: int = 100, tolerance: float = 1e-3
) -> DataFrame:
    """Documents that the model was not fitted on, with their topic distribution ``shares``.

    Terms outside the model's vocabulary take no part.  A text of words becomes shares in one
    Python worker, without its vector on the way through the JVM.
    """
    if _of_words(docs, terms):
        shares = _shares(fitted, iterations, tolerance)

        def inferred(at: pa.ListArray, n: pa.ListArray) -> pa.ListArray:
            found = shares(*[np.split(x.values.to_numpy(), x.offsets.to_numpy()[1:-1]) if len(x) else [] for x in (at, n)])
            ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

        return ngram_vectors(docs, terms, fitted.terms, inferred, "shares")
    vectors = document_vectors(docs, doc_id, terms, fitted.terms)
    columns = [name for name in docs.columns if name != terms]
    return doc_topics(TopicModel(fitted.counts, fitted.terms, fitted.alpha, vectors), columns, iterations, tolerance)


def doc_topics(fitted: TopicModel, id_columns: list[str], iterations: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """The documents with their topic distribution as an array ``shares``.

    A document without vocabulary terms keeps the even prior.
    """
    inferred = _shares(fitted, iterations, tolerance)

    @F.pandas_udf("array<double>")
    def shares(at: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(list(inferred(list(at), list(n))))

    return fitted.vectors.select(*id_columns, shares("at", "n").alias("shares"))


def topic_terms(fitted: TopicModel, n: int | None = None) -> DataFrame:
    """``(topic, rank, term, weight)`` of the ``n`` heaviest terms per topic, or of all; ties in column order."""
    weights = fitted.counts / fitted.counts.sum(axis=1, keepdims=True)
    rows = []
    for topic, row in enumerate(weights):
        for rank, at in enumerate(np.argsort(-row, kind="stable")[:n].tolist()):
            rows.append((topic, rank, fitted.terms[at], float(row[at])))
    return fixed_table(
        SparkSession.getActiveSession(), rows, "topic int, rank int, term string, weight double")


def long_shares(shares: DataFrame) -> DataFrame:
    """One row per document and topic: ``topic`` and ``share``."""
    keep = [c for c in shares.columns if c != "shares"]
    return shares.select(*keep, F.posexplode("shares").alias("topic", "share"))


def top_docs(shares: DataFrame, doc_id: str, n: int) -> DataFrame:
    """The ``n`` documents with the largest share of each topic."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("share"), doc_id))
    return long_shares(shares).withColumn("rank", rank).filter(F.col("rank") <= n)


def daily_shares(shares: DataFrame, day: str) -> DataFrame:
    """Mean share of each topic per day, and share times documents as ``volume``."""
    return long_shares(shares).groupBy(day, "topic").agg(
        F.avg("share").alias("share"), F.count(F.lit(1)).alias("docs")
    ).withColumn("volume", F.col("share") * F.col("docs"))


def likely_topics(shares: DataFrame, minimum: float = 0.05) -> DataFrame:
    """Topics of each document with at least the minimum share."""
    return long_shares(shares).filter(F.col("share") >= minimum)


def umass_coherence(vectors: DataFrame, names: list[str], topics: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, coherence`` of lists of top terms, from the documents that hold their terms together.

    ``topics`` has ``keys, rank, term``: a few terms for each topic, or for each topic and
    day.  Documents become bitmaps, one for each listed term, so a pair of terms has as many
    documents in common as its bitmaps have equal bits; each pair is counted once, however
    many days list it, and a partition hands on one count a pair.  No pair of documents or of
    all the terms of a document is formed.  Terms that no document holds count as 0.
    """
    spark = vectors.sparkSession
    place = {term: at for at, term in enumerate(names)}
    listed = topics.select(*keys, "rank", "term").collect()  # as many rows as topics, times days, times terms of a list
    lists: dict[tuple, list] = {}
    for row in sorted(listed, key=lambda row: row["rank"]):
        lists.setdefault(tuple(row[key] for key in keys), []).append(row["term"])
    cells = [(*key, later, earlier) for key, terms in lists.items() for i, later in enumerate(terms) for earlier in terms[:i]]
    terms = sorted({row["term"] for row in listed})
    pairs = sorted({tuple(sorted(cell[-2:])) for cell in cells} | {(term, term) for term in terms})
    number = {term: i for i, term in enumerate(terms)}
    where = np.full(len(names) + 1, -1)
    for term in terms:
        where[place.get(term, len(names))] = number[term]
    left, right = (np.array([number[pair[side]] for pair in pairs], int) for side in (0, 1))

    def count(batches):
        together = np.zeros(len(pairs), np.int64)
        for batch in batches:
            for rows in side_by_side(batch):
                at = np.concatenate([np.zeros(0, int), *rows["at"]]).astype(int)
                doc = np.repeat(np.arange(len(rows)), [len(x) for x in rows["at"]])
                known = where[at] >= 0
                held = np.zeros((len(terms), len(rows)), bool)
                held[where[at][known], doc[known]] = True
                bits = np.packbits(held, axis=1)
                together += np.bitwise_count(bits[left] & bits[right]).sum(axis=1, dtype=np.int64)
        yield pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "docs": together})

    counted = vectors.select("at").mapInPandas(count, "a string, b string, docs long").groupBy("a", "b").agg(
        F.sum("docs").alias("docs"))
    total = vectors.agg(F.count(F.lit(1)).alias("n"))
    types = [f"{key} {topics.schema[key].dataType.simpleString()}" for key in keys]
    wanted = fixed_table(spark, cells, ", ".join([*types, "later string", "earlier string"])).withColumns({
        "a": F.least("later", "earlier"), "b": F.greatest("later", "earlier")})
    alone = counted.filter("a = b").select(F.col("a").alias("earlier"), F.col("docs").alias("base"))
    n = total.scalar()
    ratio = (F.coalesce("docs", F.lit(0)) / n + 1e-12) / (F.col("base") / n)
    return (
        wanted.join(counted, ["a", "b"], "left").join(alone, "earlier", "left").groupBy(*keys)
        .agg(F.avg(F.when(F.col("base") > 0, F.log(ratio)).otherwise(0.0)).alias("coherence"))
    )


# ---------------------------------------------------------------- carrying topics over


def _near_one(*keys) -> Column:
    """Positive start weight around 1 with deviation 0.1, fixed by a digest of the keys.

    The cube of a shifted normal value follows the gamma distribution of shape 100
    and scale 1/100 closely; the normal value is a sum of twelve uniforms.
    """
    def uniform(i):
        digest = F.md5(F.concat_ws(":", *keys, F.lit(str(i))).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)

    normal = sum([uniform(i) for i in range(1, 12)], uniform(0)) - 6.0
    spread = 1.0 / 900.0
    return F.pow(1.0 - spread + normal * math.sqrt(spread), 3)


def carry_topics(
    weights: DataFrame, topic_share: DataFrame, vocabulary: DataFrame, k: int, label: str
) -> DataFrame:
    """Topic weights moved onto another vocabulary and number of topics.

    ``weights`` is ``(topic, term, weight)``, ``topic_share`` ``(topic, share)`` of
    the last day, ``vocabulary`` ``(term)``.  Known terms keep their weight, new
    ones start near 1.  Too many topics: the least frequent are dropped.  Too few:
    topics named ``label:i`` are added.  The topics are a handful of names.
    """
    ranked = topic_share.withColumn("order", F.row_number().over(Window.orderBy(F.desc("share"), "topic")))
    kept = ranked.filter(F.col("order") <= k).select("topic")
    old = [row.topic for row in kept.orderBy("topic").collect()]
    added = [f"{label}:{i}" for i in range(k - len(old))]
    names = F.array(*[F.lit(name) for name in [str(t) for t in old] + added])
    grid = vocabulary.select("term").distinct().select("term", F.explode(names).alias("topic_name"))
    known = weights.withColumn("topic_name", F.col("topic").cast("string")).select("term", "topic_name", "weight")
    return grid.join(known, ["term", "topic_name"], "left").select(
        "term", "topic_name", F.coalesce("weight", _near_one("term", "topic_name")).alias("weight")
    )
