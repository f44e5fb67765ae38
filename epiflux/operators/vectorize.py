"""Bag-of-words tables and vectors.

Terms are given as an array column, or as a text of cleaned words (``word_text``) whose
words and bigrams are the terms; the second form never writes a document's terms out.
"""

from __future__ import annotations

import os
import re
import sys
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType

from epiflux.functions.fixed_values import STOP_WORDS, TERM_RULES
from epiflux.functions.text import NONWORDS, TOKEN, prepare_text, tokens, with_bigrams
from epiflux.session import stored
from epiflux.sources.tables import fixed_table

#: Texts whose words are counted at once, and pairs and texts a task holds before it hands on the counts of pairs.
_TEXTS, _HELD_PAIRS, _HELD_TEXTS = 2_000, 2_000_000, 1 << 24
#: Counts of words, some texts each, that a task holds before it sums them up and hands them on.
_HELD_COUNTS = 2_000_000
#: Bytes of texts that are cut into words at once, so that their arrays stay in the cache.
_CUT = 200_000
# The numbers of NONWORDS, begun with a class of characters, which is searched for fast.
_NUMBERS = r"[0-9]\d*+,?+(?:\d++,?+)*+(?:\.?\d++)?+"
#: Most frequent words that a task may know by number; more, which takes as many ties, are counted as strings.
MOST_WORDS = 500_000


def with_terms(df: DataFrame, text, out: str = "terms") -> DataFrame:
    """Add the cleaned words and bigrams of a message as ``out``.

    Words get a projection of their own, so they are computed once and not again
    for every use in the bigrams.
    """
    words = df.withColumn("_words", tokens(prepare_text(text)))
    return words.withColumn(out, with_bigrams("_words")).drop("_words")


def term_counts(docs: DataFrame, doc_id: str, terms: str) -> DataFrame:
    """``(doc_id, term, n)`` of an array column; one row per document in, no shuffle.

    Terms are sorted inside the row and counted as the lengths of equal runs.  The
    outer form of inline keeps the optimizer from pushing an emptiness test, and
    with it a second tokenization, below the projections.
    """
    def at(index):
        return F.get(F.col("_sorted"), index)

    runs = (
        docs.select(doc_id, F.sort_array(terms).alias("_sorted"))
        .withColumn(
            "_starts",
            F.filter(
                F.sequence(F.lit(0), F.size("_sorted")),
                lambda i: (i < F.size("_sorted")) & ((i == 0) | (at(i) != at(i - 1))),
            ),
        )
        .withColumn(
            "_ends", F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_sorted")))
        )
    )
    pairs = F.zip_with(
        "_starts", "_ends",
        lambda start, end: F.struct(at(start).alias("term"), (end - start).cast("bigint").alias("n")),
    )
    return runs.select(doc_id, F.inline_outer(pairs)).filter(F.col("term").isNotNull())


def vocabulary(
    counts: DataFrame, n_docs: DataFrame, min_df: int = 10, max_df: float = 0.9,
    max_terms: int | None = 10_000,
) -> DataFrame:
    """``(term, docs, total)`` of the terms kept.

    Kept are terms in at least ``min_df`` documents and at most the share ``max_df``
    of them (``n_docs`` is a one-cell frame), then the ``max_terms`` most frequent;
    ties in term order.
    """
    stats = counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")
    )
    kept = stats.filter((F.col("docs") >= min_df) & (F.col("docs") <= n_docs.scalar() * F.lit(max_df)))
    return kept if max_terms is None else kept.orderBy(F.desc("total"), "term").limit(max_terms)


def word_text(text) -> Column:
    """The cleaned words of a lower-case text, as ``tokens`` of ``prepare_text``, with a space between them."""
    # a look at the first character spares the alternatives at most places
    nonwords = re.compile(f"(?=[<hH0-9])(?i:{NONWORDS.removeprefix('(?i)')})", re.ASCII)
    numbers = re.compile(_NUMBERS, re.ASCII)
    rules = [(os.path.commonprefix([word.strip("^$") for word in pattern.split("|")]), re.compile(pattern), term)
             for pattern, term in TERM_RULES]
    character = re.compile(TOKEN.replace(r"[\p{L}\p{N}_]", r"\w").replace("{2,}", ""))  # the same class
    stop = pa.array(list(STOP_WORDS), pa.string())
    inside: list[np.ndarray] = []

    def prepared(raw: bytes) -> str:
        value = raw.decode("utf-8", "replace")
        value = (nonwords if "<" in value or "://" in value else numbers).sub("", value)
        for begin, pattern, term in rules:
            if begin in value:
                value = pattern.sub(term, value)
        return value

    def of_words() -> np.ndarray:
        """Whether a code point belongs to words."""
        if not inside:
            found = np.zeros(sys.maxunicode + 1, bool)
            points = np.arange(len(found), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
            for run in character.finditer(points):
                found[slice(*run.span())] = True
            inside.append(found)
        return inside[0]

    def cut(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the word texts, and where each ends.  A byte of what follows a word becomes the space after it."""
        text = "".join([value + "\n" for value in values])
        data, signs = np.frombuffer(bytearray(text, "utf-8"), np.uint8), np.fromiter(map(len, values), np.int64, len(values)) + 1
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        word = np.concatenate([[False], of_words()[points]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= 2
        starts, ends, stops = starts[long], ends[long], np.cumsum(signs)
        owner = np.searchsorted(stops, starts, side="right")
        if len(data) != len(points):
            at = np.flatnonzero(data & 0xC0 != 0x80)
            starts, ends = at[starts], at[ends]

        def chosen(first, last):
            change = np.zeros(len(data) + 1, np.int8)
            change[first] = 1
            change[last] -= 1
            return data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]

        spelt = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        names = pa.StringArray.from_buffers(len(starts), pa.py_buffer(spelt), pa.py_buffer(chosen(starts, ends)))
        keep = ~pc.is_in(names, stop).to_numpy(zero_copy_only=False)
        starts, ends, owner = starts[keep], ends[keep], owner[keep]
        data[ends] = 32
        more = np.append(owner[1:] == owner[:-1], False) if len(owner) else owner.astype(bool)
        sizes = np.bincount(owner, ends - starts + more, len(values)).astype(np.int64)
        return chosen(starts, ends + more), np.cumsum(sizes)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        parts, held, size = [], [], 0

        def flush():
            data, ends = cut([value or "" for value in held])
            ends = pa.array(np.concatenate([[0], ends]), pa.int32())
            found = pa.StringArray.from_buffers(len(held), ends.buffers()[1], pa.py_buffer(data))
            missing = pa.array([value is None for value in held], pa.bool_())
            parts.append(pc.if_else(missing, pa.scalar(None, pa.string()), found))

        for raw in texts.cast(pa.binary()):
            raw = raw.as_py()
            held.append(None if raw is None else prepared(raw))
            size += len(raw or b"")
            if size >= _CUT:
                flush()
                held, size = [], 0
        if held:
            flush()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(text)


def _coded(column: pa.Array):
    """Words of a column of word texts, some texts at a time: different words, and of all words in turn the place among them and the place of their text.

    NULL has no words.  An empty text has one empty word.
    """
    for first in range(0, len(column), _TEXTS):
        lists = pc.split_pattern(column.slice(first, _TEXTS), " ")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        words = lists.flatten().dictionary_encode()
        yield words.dictionary, words.indices.to_numpy(), np.repeat(np.arange(len(lists)), sizes)


def _numbered(column: pa.Array, names: pa.Array):
    """As ``_coded``, with a word's place in ``names``, -1 for others, and the number of texts."""
    for first in range(0, len(column), _TEXTS):
        part = column.slice(first, _TEXTS)
        for words, code, doc in _coded(part):
            yield pc.fill_null(pc.index_in(words, names), -1).to_numpy().astype(np.int64)[code], doc, len(part)


def _neighbours(at: np.ndarray, doc: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and texts of the pairs of neighbouring words that both have a number."""
    both = (at[:-1] >= 0) & (at[1:] >= 0) & (doc[:-1] == doc[1:])
    return at[:-1][both] * words + at[1:][both], doc[1:][both]


def _sums(part: Column | None) -> list[str]:
    return ["docs", "total"] + (["part_docs", "part_total"] if part is not None else [])


def _summed(parts: DataFrame, key: str, part: Column | None) -> DataFrame:
    return parts.groupBy(key).agg(*[F.sum(name).alias(name) for name in _sums(part)])


def _with_part(docs: DataFrame, words: str, part: Column | None) -> DataFrame:
    return docs.select(words, *([] if part is None else [F.coalesce(part, F.lit(False)).alias("part")]))


def word_statistics(docs: DataFrame, words: str, part: Column | None = None) -> DataFrame:
    """``(term, docs, total)`` of every word of a column of word texts.

    With ``part``, a condition, also ``part_docs, part_total`` over the texts where it holds.
    """
    columns = _sums(part)

    def run(batches):
        held, size = [], 0

        def summed():
            sums = pa.Table.from_batches(held).group_by("term", use_threads=False).aggregate([(name, "sum") for name in columns])
            return sums.rename_columns({f"{name}_sum": name for name in columns}).select(["term", *columns]).to_batches()

        for batch in batches:
            for at, (names, code, doc) in enumerate(_coded(batch.column(0))):
                both = np.sort(doc * len(names) + code)
                once = both[np.diff(both, prepend=-1) != 0]
                sums = [np.bincount(once % max(1, len(names)), minlength=len(names)), np.bincount(code, minlength=len(names))]
                if len(columns) > 2:
                    inside = batch.column(1).slice(at * _TEXTS, _TEXTS).to_numpy(zero_copy_only=False)
                    inside_once = once[inside[once // max(1, len(names))]] % max(1, len(names))
                    sums += [np.bincount(found, minlength=len(names)) for found in (inside_once, code[inside[doc]])]
                found = pa.record_batch([names, *map(pa.array, sums)], ["term", *columns])
                held.append(found.filter(pc.not_equal(names, "")))
                size += len(held[-1])
                if size >= _HELD_COUNTS:
                    yield from summed()
                    held, size = [], 0
        if held:
            yield from summed()

    schema = ", ".join(["term string", *[f"{name} bigint" for name in columns]])
    return _summed(_with_part(docs, words, part).mapInArrow(run, schema), "term", part)


def pair_statistics(docs: DataFrame, words: str, names: list[str], part: Column | None = None) -> DataFrame:
    """``(pair, docs, total)`` of the pairs of neighbouring words out of ``names``; with ``part`` as ``word_statistics``.

    A pair's number is that of its first word, times the number of names, plus that of its second.
    """
    listed, columns = pa.array(names, pa.string()), _sums(part)

    def run(batches):
        pairs, texts, inside, seen, size = [], [], [], 0, 0

        def flush():
            bits = seen.bit_length()  # a pair takes 38 bits at most, a text 25
            both = np.sort(np.concatenate(pairs) << bits | np.concatenate(texts))
            pair, again = both >> bits, np.diff(both, prepend=-1) != 0
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            sums = [np.add.reduceat(again.astype(np.int64), starts), np.diff(starts, append=len(pair)).astype(np.int64)]
            if inside:
                held = np.concatenate(inside)[both & ((1 << bits) - 1)]
                sums += [np.add.reduceat(found.astype(np.int64), starts) for found in (again & held, held)]
            return pa.record_batch([pa.array(pair[starts]), *map(pa.array, sums)], ["pair", *columns])

        for batch in batches:
            first = 0
            for at, doc, n_texts in _numbered(batch.column(0), listed):
                pair, text = _neighbours(at, doc, len(names))
                pairs.append(pair)
                texts.append(text + seen)
                if len(columns) > 2:
                    inside.append(batch.column(1).slice(first, n_texts).to_numpy(zero_copy_only=False))
                first, seen, size = first + n_texts, seen + n_texts, size + len(pair)
                if size >= _HELD_PAIRS or seen >= _HELD_TEXTS:
                    if size:
                        yield flush()
                    pairs, texts, inside, seen, size = [], [], [], 0, 0
        if size:
            yield flush()

    schema = ", ".join(["pair bigint", *[f"{name} bigint" for name in columns]])
    return _summed(_with_part(docs, words, part).mapInArrow(run, schema), "pair", part)


def ngram_vocabulary(
    docs: DataFrame, words: str, min_df: int = 10, max_df: float = 0.9, max_terms: int = 10_000,
) -> DataFrame:
    """``vocabulary`` of the words and bigrams of a column of word texts, as a written table.

    A bigram is in no more documents, and has no larger total, than each of its words.  So
    only words in ``min_df`` documents whose total reaches that of the last of ``max_terms``
    words can be in a bigram that is kept, and pairs of other words are not formed.  Such
    words are as many as the cap, those too common for it, and ties.
    """
    return _vocabularies(docs, words, None, [min_df], max_df, max_terms)[0]


def ngram_vocabularies(
    docs: DataFrame, words: str, part: Column, min_df: int = 10, part_min_df: int = 10, max_df: float = 0.9,
    max_terms: int = 10_000,
) -> list[DataFrame]:
    """``ngram_vocabulary`` of all documents, and of those where ``part`` holds, from one count of words and one of pairs."""
    return _vocabularies(docs, words, part, [min_df, part_min_df], max_df, max_terms)


def _vocabularies(
    docs: DataFrame, words: str, part: Column | None, min_df: list[int], max_df: float, max_terms: int,
) -> list[DataFrame]:
    inside = [F.lit(True), part][:len(min_df)]
    n_docs = docs.agg(*[F.count_if(condition) for condition in inside]).first()
    counts = [(F.col("docs"), F.col("total")), (F.col("part_docs"), F.col("part_total"))][:len(min_df)]
    often = [n >= max(1, least) for (n, _), least in zip(counts, min_df)]
    kept = [often[i] & (n <= F.lit(n_docs[i]) * F.lit(max_df)) for i, (n, _) in enumerate(counts)]
    singles = stored(word_statistics(docs, words, part).filter(reduce(or_, often)), "word-statistics")
    reached = []
    for i, (_, total) in enumerate(counts):
        best = singles.filter(kept[i]).orderBy(total.desc()).limit(max_terms)
        cut = best.agg(F.count(F.lit(1)).alias("n"), F.min(total).alias("least")).first()
        reached.append(total >= (cut.least if cut.n == max_terms else 0))
    frequent = singles.filter(reduce(or_, [a & b for a, b in zip(often, reached)]))
    if frequent.count() > MOST_WORDS:
        return [_plain_vocabulary(docs.filter(condition), words, one, max_terms) for condition, one in zip(inside, kept)]
    names = sorted(row.term for row in frequent.select("term").collect())
    found = [singles.filter(one) for one in kept]
    if names:
        pairs = pair_statistics(docs, words, names, part).filter(reduce(or_, [a & b for a, b in zip(kept, reached)]))
        if part is not None:
            pairs = stored(pairs, "pair-statistics")
        listed = fixed_table(docs.sparkSession, enumerate(names), "at bigint, word string")
        first = F.broadcast(listed.select(F.col("at").alias("first"), F.col("word").alias("left")))
        second = F.broadcast(listed.select(F.col("at").alias("second"), F.col("word").alias("right")))
        named = pairs.withColumns({
            "first": F.expr(f"pair div {len(names)}"), "second": F.col("pair") % len(names)
        }).join(first, "first").join(second, "second")
        named = named.select(F.concat_ws(" ", "left", "right").alias("term"), *_sums(part))
        found = [rows.unionByName(named.filter(a & b)) for rows, a, b in zip(found, kept, reached)]
    return [
        stored(rows.select("term", n.alias("docs"), total.alias("total")).orderBy(F.desc("total"), "term").limit(max_terms),
               "vocabulary")
        for rows, (n, total) in zip(found, counts)
    ]


def _plain_vocabulary(docs: DataFrame, words: str, kept: Column, max_terms: int) -> DataFrame:
    """The vocabulary from all terms as strings; ``kept`` is on ``docs`` or ``part_docs`` of a term."""
    terms = docs.select(F.monotonically_increasing_id().alias("doc"), with_bigrams(
        F.filter(F.split(words, " "), lambda word: word != "")).alias("terms"))
    stats = term_counts(terms, "doc", "terms").groupBy("term").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    rows = stats.withColumn("part_docs", F.col("docs")).filter(kept).drop("part_docs")
    return stored(rows.orderBy(F.desc("total"), "term").limit(max_terms), "vocabulary")


def ngram_vectors(docs: DataFrame, words: str, names: list[str], derive=None, out: str = "") -> DataFrame:
    """The documents with ``at, n`` in place of a column of word texts, made row by row.

    They are the indexes in ``names`` of the document's words and bigrams, ascending, and their counts.
    ``derive`` makes lists of doubles from the two in the same worker, and they stand as ``out`` in their place.
    """
    parts = [name.split(" ") for name in names]
    listed = sorted({word for part in parts for word in part})
    number, listed = {word: at for at, word in enumerate(listed)}, pa.array(listed, pa.string())
    single = np.full(len(number) + 1, -1)  # the last is for words without a number
    pairs = sorted((number[part[0]] * len(number) + number[part[1]], at) for at, part in enumerate(parts) if len(part) == 2)
    keys, places = (np.array([pair[side] for pair in pairs], np.int64) for side in (0, 1))
    for at, part in enumerate(parts):
        if len(part) == 1:
            single[number[part[0]]] = at
    keep = [column for column in docs.columns if column != words]

    def vectors(at: np.ndarray, doc: np.ndarray, n_texts: int) -> list[pa.Array]:
        term = single[at]
        codes = [(doc * len(names) + term)[term >= 0]]
        pair, text = _neighbours(at, doc, len(number))
        if len(keys):
            place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            known = keys[place] == pair
            codes.append(text[known] * len(names) + places[place[known]])
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        ends = pa.array(np.searchsorted(code, np.arange(n_texts + 1) * len(names)), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(code % len(names), pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))]

    def run(batches):
        for batch in batches:
            first = 0
            for at, doc, n_texts in _numbered(batch.column(len(keep)), listed):
                rows = batch.slice(first, n_texts)
                first += n_texts
                found = vectors(at, doc, n_texts)
                found = found if derive is None else [derive(*found)]
                yield pa.record_batch([*rows.columns[:-1], *found], fields)

    schema = docs.select(*keep).schema
    if derive is None:
        schema = schema.add("at", ArrayType(IntegerType())).add("n", ArrayType(LongType()))
    else:
        schema = schema.add(out, ArrayType(DoubleType()))
    fields = schema.fieldNames()
    return docs.select(*keep, words).mapInArrow(run, schema)


def in_vocabulary(counts: DataFrame, vocab: DataFrame, max_terms: int | None = 10_000) -> DataFrame:
    """Counts restricted to the vocabulary.

    A vocabulary cut to ``max_terms`` is small whatever the corpus and is
    broadcast; an uncut one joins by whatever its size allows.
    """
    names = vocab.select("term")
    if max_terms is not None and max_terms <= 100_000:
        names = F.broadcast(names)
    return counts.join(names, "term", "left_semi")


def count_vectors(
    docs: DataFrame, doc_id: str, terms: str, out: str = "features", min_df: int = 10, max_df: float = 0.9,
    max_terms: int = 10_000,
) -> tuple[list[str], DataFrame]:
    """Sparse count vectors for model fitting, and the vocabulary in column order.

    The vocabulary is found by the aggregate above, most frequent term first, so
    equal counts keep one order in every run.  At most ``max_terms`` names reach
    the driver, where the vectorizer needs them.
    """
    n_docs = docs.agg(F.count(F.lit(1)))
    vocab = vocabulary(term_counts(docs, doc_id, terms), n_docs, min_df, max_df, max_terms)
    names = [row.term for row in vocab.orderBy(F.desc("total"), "term").collect()]
    if not names:
        raise ValueError("no term is frequent enough for the vocabulary")
    model = CountVectorizerModel.from_vocabulary(names, inputCol=terms, outputCol=out)
    return names, model.transform(docs)
