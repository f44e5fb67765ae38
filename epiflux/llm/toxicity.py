"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first four and five
characters, hashed into buckets.  Besides a weight per bucket the machine learns a short
vector per bucket; the product of two vectors is the weight of their pair, so that words
which are toxic only together (an insult and whom it is aimed at) are told from the same
words apart.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the hash.
BUCKETS = 1 << 22
#: Most labelled rows that a fit reads, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Least z value of a bucket that is kept for itself; others are kept for their pairs.
LEAST_Z = 3.0
#: Least rows of a bucket that is looked at.
LEAST_ROWS = 5
#: Length of a bucket's vector.
FACTORS = 4
#: Cells of buckets and rows that are laid out at once while pairs are counted.
_CELLS = 1_000_000
#: Words whose buckets a task remembers.
_REMEMBERED = 200_000
_STEPS, _RATE, _DECAY = 150, 0.1, 2e-3
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct lower-cased words: letters, digits and everything above ASCII."""
    return set(text.lower().encode().translate(_FOLD).split()) if text else set()


def terms_of(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings."""
    import xxhash

    text = word.decode()
    terms = [text, *(f"{text[:n]}*" for n in (4, 5) if len(text) >= n)]
    return [xxhash.xxh3_64_intdigest(term) % BUCKETS for term in terms]


class FactorizationMachine:
    """``weights`` and ``vectors`` by bucket, and a constant."""

    def __init__(self, constant: float, weights: dict[int, float], vectors: dict[int, np.ndarray]):
        self.constant, self.weights, self.vectors = constant, weights, vectors
        self.remembered: dict[bytes, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        """Probability that a text is toxic; an empty text gets the base rate."""
        words = words_of(text)
        remembered = self.remembered
        if len(remembered) > _REMEMBERED:
            remembered.clear()
        for word in [word for word in words if word not in remembered]:
            remembered[word] = tuple(t for t in terms_of(word) if t in self.weights)
        found = set().union(*map(remembered.__getitem__, words))
        value = self.constant
        if found:
            vectors = np.array([self.vectors[term] for term in sorted(found)])
            pairs = (vectors.sum(axis=0) ** 2 - (vectors**2).sum(axis=0)).sum() / 2
            value += sum(self.weights[term] for term in sorted(found)) + float(pairs)
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def _screen(terms: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets whose share differs between the classes, by the z value of log odds, and those of telling pairs."""
    a, b = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for found, toxic in zip(terms, labels):
        (a if toxic else b)[found] += 1
    buckets = np.nonzero(a + b >= LEAST_ROWS)[0]
    a, b = a[buckets], b[buckets]
    n_toxic, n_clean = labels.sum(), len(labels) - labels.sum()
    odds = np.log((a + 0.5) / (n_toxic - a + 0.5)) - np.log((b + 0.5) / (n_clean - b + 0.5))
    spread = 1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n_toxic - a + 0.5) + 1 / (n_clean - b + 0.5)
    alone = buckets[np.abs(odds) / np.sqrt(spread) >= LEAST_Z]
    return np.union1d(alone, _paired(terms, labels, buckets, a, b))


def _paired(
    terms: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, clean: np.ndarray,
) -> np.ndarray:
    """Buckets of pairs that meet with another share of toxic rows than their single odds give together.

    Every pair is counted.  The measure is the likelihood ratio against odds that multiply;
    its bound grows with the number of possible pairs, so that chance gives none.  A pair
    that meets in fewer rows than a pure pair needs for the bound is passed over.
    """
    if len(buckets) < 2:
        return buckets[:0]
    base = labels.mean()
    bound = 2 * np.log(len(buckets) * (len(buckets) - 1) / 2) + 4
    least = int(np.ceil(bound / (2 * -np.log(min(base, 1 - base)))))
    # the most frequent bucket first: a pair is counted at its more frequent one
    order = np.argsort(-(toxic + clean), kind="stable")
    order = order[(toxic + clean)[order] >= least]
    k = len(order)
    if k < 2:
        return buckets[:0]
    odds = ((toxic + base) / (clean + 1 - base))[order]
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets[order]] = np.arange(k)
    rows = [np.sort(found[found >= 0]) for found in (place[found] for found in terms)]
    ends = np.cumsum((toxic + clean)[order])

    def laid_out(first: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Cells of some buckets from ``first``, each with its row and the place behind it in the row; and the bucket after them."""
        begin = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + _CELLS, side="right")))
        free = np.concatenate([[0], ends[first:last - 1] - begin])
        owners, spots = np.empty(ends[last - 1] - begin, np.int32), np.empty(ends[last - 1] - begin, np.int32)
        for row, found in enumerate(rows):
            low, high = np.searchsorted(found, (first, last))
            at = free[found[low:high] - first]
            owners[at], spots[at] = row, np.arange(low + 1, high + 1)
            free[found[low:high] - first] += 1
        return last, owners, spots

    marks = labels > 0
    telling = np.zeros(k, bool)

    def judge(i, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        n, joint = a + b, odds[i] * odds[j] * (1 - base) / base
        share = joint / (1 + joint)
        # twice the square is never below the likelihood ratio
        near = np.nonzero(2 * (a - n * share) ** 2 >= bound * n * share * (1 - share))[0]
        a, b, n, share = a[near], b[near], n[near], share[near]
        ratio = 2 * (a * np.log(np.maximum(a, 1) / (n * share)) + b * np.log(np.maximum(b, 1) / (n * (1 - share))))
        hit = near[ratio >= bound]
        telling[j[hit]] = True
        telling[i if np.isscalar(i) else i[hit]] |= bool(len(hit)) if np.isscalar(i) else True

    def judge_rare(held: list[np.ndarray]) -> None:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        pairs = keys >> 1
        first = np.nonzero(np.diff(pairs, prepend=-1))[0]
        a = np.add.reduceat(np.where(keys & 1, counts, 0), first)
        n = np.add.reduceat(counts, first)
        chosen = np.nonzero(n >= least)[0]
        pairs = pairs[first[chosen]]
        judge(pairs // k, pairs % k, a[chosen], n[chosen] - a[chosen])

    held, size, last, begin = [], 0, 0, 0
    for i in range(k):
        if i == last:
            begin = ends[i - 1] if i else 0
            owners = spots = None
            last, owners, spots = laid_out(i)
        at = slice((ends[i - 1] if i else 0) - begin, ends[i] - begin)
        mine = marks[owners[at]]
        parts = [rows[row][spot:] for row, spot in zip(owners[at].tolist(), spots[at].tolist())]
        total = sum(map(len, parts))
        if total * 8 > k - i:
            a, b = (
                np.bincount(np.concatenate([parts[0][:0], *(parts[r] for r in np.nonzero(side)[0].tolist())]), minlength=k)
                for side in (mine, ~mine)
            )
            j = np.nonzero(a + b >= least)[0]
            if len(j):
                judge(i, j, a[j], b[j])
        elif total:
            held.append((np.concatenate(parts).astype(np.int64) + i * k) * 2 + np.repeat(mine, list(map(len, parts))))
            size += total
        if held and (size > 2_000_000 or i == k - 1):
            judge_rare(held)
            held, size = [], 0
    if held:
        judge_rare(held)
    return buckets[order[telling]]


def train(terms: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
    """Fit by full-batch Adam on the log loss; the same rows give the same model.

    Without rows of both classes the model is the base rate alone (below one half for no rows).
    """
    base = (labels.sum() + 0.5) / (len(labels) + 2)
    constant = float(np.log(base / (1 - base)))
    if not 0 < labels.sum() < len(labels):
        return FactorizationMachine(constant, {}, {})
    kept = _screen(terms, labels)
    if not len(kept):
        return FactorizationMachine(constant, {}, {})
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    inside = [found[found >= 0] for found in (place[t] for t in terms)]
    rows = np.repeat(np.arange(len(terms)), [len(found) for found in inside])
    columns = np.concatenate(inside)
    n, k = len(labels), len(kept)
    start = np.random.default_rng(7).normal(0, 0.02, (k, FACTORS))
    params = [np.array([constant]), np.zeros(k), start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, _STEPS + 1):
        c, w, v = params
        sums = np.stack([np.bincount(rows, v[columns, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(rows, (v**2).sum(axis=1)[columns], n)
        value = c[0] + np.bincount(rows, w[columns], n) + ((sums**2).sum(axis=1) - squares) / 2
        error = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - labels) / n
        by_row = error[rows]
        mixed = [np.bincount(columns, by_row * (sums[rows, f] - v[columns, f]), k) for f in range(FACTORS)]
        slopes = [
            np.array([error.sum()]),
            np.bincount(columns, by_row, k) + _DECAY * w / n,
            np.stack(mixed, axis=1) + _DECAY * v / n,
        ]
        for p, g, m, s in zip(params, slopes, first, second):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= _RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    c, w, v = params
    buckets = kept.tolist()
    return FactorizationMachine(float(c[0]), dict(zip(buckets, w.tolist())), dict(zip(buckets, v)))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> FactorizationMachine:
    """Learn from at most ``sample_rows`` of the labelled rows, chosen by a hash of the key.

    The chosen keys have that bound, so they are broadcast to the scan of the texts; the
    terms of the chosen texts meet in one task, which holds at most ``sample_rows`` of them.
    A NULL key or label is passed over; a key labelled twice counts as its higher label.
    """
    known = (
        labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("_label"))
        .dropna().groupBy("_key").agg(F.max("_label").alias("_label"))
    )
    # the rows of the lowest hashes: the same ones however the labels are laid out
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)

    @F.arrow_udf("array<int>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([
                sorted({term for word in words_of(text) for term in terms_of(word)}) for text in batch.to_pylist()
            ], pa.list_(pa.int32()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            ends, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            held += [
                (key, label, values[a:b].copy()) for key, label, a, b
                in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, ends[1:])
            ]
        held.sort(key=lambda row: (row[0], row[1], row[2].tobytes()))
        model = train([row[2] for row in held], np.array([float(row[1] > 0) for row in held]))
        parts = pickle.dumps((model.constant, model.weights, model.vectors))
        yield pa.record_batch([pa.array([parts])], ["model"])

    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    found = texts.join(F.broadcast(chosen), "_key").select("_key", "_label", hashed("_text").alias("_terms"))
    parts = found.repartition(1).mapInArrow(learn, "model binary").first().model
    return FactorizationMachine(*pickle.loads(parts))


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score, between 0 and 1, of every whole text; NULL and empty texts get the base rate."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(text) for text in batch.to_pylist()], pa.float64())

    return docs.withColumn(name, scored(F.col(f"`{text}`")))
