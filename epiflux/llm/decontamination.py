"""Benchmark decontamination: one automaton over normalised test items.

Words are runs of digits, a-z (A-Z lower-cased) and characters above ASCII.  Every ten
consecutive words of an item are a window; a shorter item is one window.  The words of
a text, joined by one space, are scanned once by an Aho-Corasick automaton over all
windows; hits are word intervals, and their offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiflux.llm.common import fresh

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_HITS = (
    "struct<n_words:bigint,words:array<struct<first:int,last:int>>,"
    "spans:array<struct<start:int,end:int>>,items:array<string>>"
)


def normalised(text: str | None) -> tuple[str, int]:
    """The words with a space before, between and after them, and their number."""
    words = (text or "").encode().translate(_FOLD).split()
    return f" {b' '.join(words).decode()} ", len(words)


def windows_of(text: str | None, width: int) -> list[str]:
    """Windows of an item in the form of ``normalised``."""
    words = normalised(text)[0].split()
    if not words:
        return []
    return [f" {' '.join(words[i:i + width])} " for i in range(max(1, len(words) - width + 1))]


def build_automaton(items: list[tuple[str, str]], width: int):
    """Automaton over the windows of ``(id, text)``; a match gives its words and item ids."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, text in items:
        for window in windows_of(text, width):
            owners.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        automaton.add_word(window, (window.count(" ") - 1, ids))
    if owners:
        automaton.make_automaton()
    return automaton if owners else None


def scan(automaton, text: str | None) -> dict:
    """Word intervals, original offsets and items of a text's hits."""
    joined, n_words = normalised(text)
    found: dict = {"n_words": n_words, "words": [], "spans": [], "items": []}
    if automaton is None or not n_words:
        return found
    at, ended, items, merged = 0, 0, set(), []
    for end, (length, ids) in automaton.iter(joined):
        ended += joined.count(" ", at, end)
        at = end
        first, last = ended - length, ended - 1  # spaces before the closing one end the words so far
        items |= ids
        while merged and merged[-1][1] >= first - 1:
            first = min(first, merged.pop()[0])
        merged.append((first, last))
    if merged:
        places = [match.span() for match in _WORD.finditer(text)]
        found["items"] = sorted(items)
        found["words"] = [{"first": first, "last": last} for first, last in merged]
        found["spans"] = [{"start": places[first][0], "end": places[last][1]} for first, last in merged]
    return found


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = 10, block_chars: int = 4_000_000,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings), ``hit_spans`` (code points).

    The items go to the tasks in blocks of about ``block_chars`` characters, one automaton
    each, so what a task holds has a bound however large the benchmark grows.  Intervals of
    several blocks are joined inside the row.  No text is shuffled.

    NULL and empty texts have no words and no hits.  Items without an id, text or words are
    passed over; a repeated item counts once.  Columns of the result that clash with columns
    of ``docs`` replace them.
    """
    items = benchmark.select(
        F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text")
    ).dropna().distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    scans = [fresh(docs, f"scan{block}") for block in range(blocks)]
    for block, name in enumerate(scans):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        docs = docs.withColumn(name, _scanner([(row.id, row.text) for row in rows], width)(F.col(f"`{text}`")))
    part = lambda field: F.array_distinct(F.flatten(F.array(*[F.col(f"`{s}`.{field}") for s in scans])))
    docs = docs.withColumns({
        "n_words": F.col(f"`{scans[0]}`.n_words"),
        "n_hit": _covered(part("words")),
        "item_ids": F.array_sort(part("items")),
        "hit_spans": F.array_sort(part("spans")),
    })
    return docs.drop(*scans)


def _scanner(items: list[tuple[str, str]], width: int):
    @F.arrow_udf(_HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = build_automaton(items, width)
        kind = pa.struct([
            ("n_words", pa.int64()),
            ("words", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ("items", pa.list_(pa.string())),
        ])
        for batch in batches:
            yield pa.array([scan(automaton, text.as_py()) for text in batch], kind)

    return hits


def _covered(intervals):
    """Words in any of the intervals."""
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n"))

    def add(acc, x):
        first = F.greatest(x["first"], acc["last"] + 1)
        return F.struct(
            F.greatest(acc["last"], x["last"]).alias("last"),
            (acc["n"] + F.greatest(x["last"] - first + 1, F.lit(0))).alias("n"),
        )

    return F.aggregate(F.array_sort(intervals), zero, add, lambda acc: acc["n"])
