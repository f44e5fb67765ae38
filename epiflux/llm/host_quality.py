"""Quality rules with verdicts on hosts.

Each text is measured once.  Rule failures are counted by host; a host's failure rate is
shrunk towards all hosts by a beta prior fitted to their rates, and a host is bad when
the rate is above ``LIMIT`` with confidence.  All documents of a bad host go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiflux.llm.common import beta_strength, fresh, with_verdicts
from epiflux.session import stored

#: Failure rate that a good host stays below.
LIMIT = 0.5
#: Standard deviations of the posterior that the rate must be above the limit.
SIGMAS = 2.0
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: str | None) -> tuple[int, ...]:
    """``MEASURES`` of a text; zero throughout for NULL and blank texts.

    Words are compared by 64-bit hashes, three at a time.
    """
    from xxhash import xxh3_64_intdigest

    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    repeated = 0
    if n > 3:
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
        grams = (hashes[:-2] * _MIX + hashes[1:-1] ^ hashes[1:-1] >> np.uint64(29)) * _MIX + hashes[2:]
        order = np.argsort(grams)
        ranked = grams[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            covered[:-2] |= twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeated = int(covered.sum())
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    return (
        n, len(text) - (len(raw) - len(raw.translate(None, _SPACES))), len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated, len(lines),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns ``MEASURES``; those that clash with columns of ``docs`` replace them."""
    kind = pa.struct([(name, pa.int64()) for name in MEASURES])

    @F.arrow_udf("struct<" + ",".join(f"{name}:bigint" for name in MEASURES) + ">")
    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [measure(text.as_py()) for text in batch]
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)] or [pa.array([], pa.int64())] * len(kind)
            yield pa.StructArray.from_arrays(columns, names=list(MEASURES))

    all_of = fresh(docs, "measures")
    found = docs.withColumn(all_of, values(F.col(f"`{text}`")))
    return found.withColumns({name: F.col(f"`{all_of}`.{name}") for name in MEASURES}).drop(all_of)


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The measures of every document with ``base_failed``, ``failed`` (any rule) and ``kept``.

    ``keep`` names the columns of ``docs`` to return, ``host`` among them (all by default).
    Texts are read once; the rest works on a written table of ``keep`` and numbers.  A
    document without a host is judged by itself.  Repeated rows are judged and counted one
    by one; a rate equal to the limit is not above it.  Columns of the result that clash with
    columns of ``docs`` replace them, but for ``host``, which must not be one of them.
    """
    keep = docs.columns if keep is None else keep
    found = measured(docs, text).select(
        *[F.col(f"`{name}`") for name in keep if name not in MEASURES], *MEASURES
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    failed = (
        F.col("base_failed") | (10 * F.col("n_symbols") > 3 * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > 50 * F.col("n_lines"))
    )
    found = stored(found.withColumn("failed", failed), "host-quality")
    hosts = stored(
        found.filter(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("k")), "host-rates")
    rate, strength = beta_strength(hosts)
    mean = (F.col("k") + rate * strength) / (F.col("n") + strength)
    spread = F.sqrt(mean * (1 - mean) / (F.col("n") + strength + 1))
    verdicts = hosts.select("host", "n", (mean - SIGMAS * spread > LIMIT).alias("bad"))
    bad = fresh(found, "bad")
    judged = with_verdicts(found, verdicts.withColumnRenamed("bad", bad), host, bad)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col(bad), F.lit(False))).drop(bad)
