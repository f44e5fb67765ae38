"""Token ids in a word-aligned binary format (Simple-8b), written and read by Spark.

A 64-bit word holds a selector in its top four bits and a run of ids of one width in the
other sixty: sixty of one bit, thirty of two, and so on to one of sixty bits.  An id that
needs more is an escape: selector 0, then the id as a word of its own.  Ids are packed in
blocks of ``BLOCK`` ids which start at a word of their own; the number of words of each
block is kept, so all blocks of a document are decoded side by side.

A file row is a run of documents in ascending id order: their ids, token counts and block
sizes, and the packed words.  Rows are parquet, so any store that Spark writes will do.
"""

from __future__ import annotations

import codecs
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiflux.llm.common import BROADCAST_IDS, kept_by_worker

#: Ids per block.
BLOCK = 256
#: Packed bytes after which a file row ends; a longer document has a row of its own.
ROW_BYTES = 1 << 14
# Ids per word and bits of an id, by selector; selector 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
# End of the fixed values.


def pack(texts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each list of ids (unsigned): its words, and the number of words of each of its blocks.

    For each position the longest run that fits is found for all positions at once; then
    words follow each other from run to run.  A run never leaves its block.
    """
    sizes = np.array([len(ids) for ids in texts], np.int64)
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum()) * BLOCK
    if not total:
        return [np.zeros(0, np.uint64) for _ in texts], [np.zeros(0, np.int32) for _ in texts]
    firsts = (np.cumsum(blocks) - blocks) * BLOCK
    ids = np.concatenate(texts).astype(np.uint64)
    largest = int(ids.max())
    padded = np.zeros(total, np.uint32 if largest < 1 << 32 else np.uint64)
    padded[np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
    best = np.zeros((total // BLOCK, BLOCK), np.int8)
    for selector in range(len(COUNTS) - 1, 0, -1):
        if not largest >> WIDTHS[selector]:
            best[:] = selector
            continue
        fits = (padded < padded.dtype.type(1 << WIDTHS[selector])).reshape(best.shape)
        reach = 1  # ids in a row that fit, from each position; what lies past the block fits
        while reach < COUNTS[selector] and fits.any():
            more = min(reach, COUNTS[selector] - reach)
            fits[:, :-more] &= fits[:, more:].copy()
            reach += more
        best[fits] = selector
    best = best.ravel()
    counts = np.array(COUNTS)
    # all blocks step from word to word side by side
    block = np.arange(total // BLOCK)
    at = block * BLOCK
    inside = np.arange(len(block)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    stop = at + np.minimum(BLOCK, np.repeat(sizes, blocks) - inside * BLOCK)
    starts, owners = [], []
    while len(at):
        starts.append(at)
        owners.append(block)
        at = at + counts[best[at]]
        on = at < stop
        at, block, stop = at[on], block[on], stop[on]
    order = np.argsort(np.concatenate(owners), kind="stable")
    starts = np.concatenate(starts)[order]
    reached = np.cumsum(np.bincount(np.concatenate(owners), minlength=total // BLOCK))
    selectors = best[starts].astype(np.int64)
    ends_of_words = np.cumsum(np.where(selectors == 0, 2, 1))
    at = ends_of_words - np.where(selectors == 0, 2, 1)
    words = np.zeros(int(ends_of_words[-1]), np.uint64)
    words[at] = selectors.astype(np.uint64) << np.uint64(60)
    offsets = starts % BLOCK
    for selector in np.unique(selectors).tolist():
        chosen = np.nonzero(selectors == selector)[0]
        first, place, offset = starts[chosen], at[chosen], offsets[chosen]
        if selector == 0:
            words[place + 1] = padded[first]
            continue
        word = words[place]
        for k in range(COUNTS[selector]):
            value = padded.take(first + k, mode="clip").astype(np.uint64)
            if k:
                value[offset + k >= BLOCK] = 0
            word |= value << np.uint64(k * WIDTHS[selector])
        words[place] = word
    block_ends = ends_of_words[reached - 1]
    block_words = np.diff(block_ends, prepend=0).astype(np.int32)
    cuts = np.cumsum(blocks)[:-1]
    doc_ends = np.concatenate([[0], block_ends])[np.cumsum(blocks)[:-1]]
    return np.split(words, doc_ends), np.split(block_words, cuts)


def unpack(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of packed words, all blocks side by side.

    Word offsets of the blocks are the running sum of ``block_words``; step by step the
    next word of every block is decoded, so the loop runs over words of a block, not ids.
    """
    words = np.asarray(words, np.uint64)
    blocks = len(block_words)
    out = np.zeros((blocks, BLOCK + 60), np.uint64)
    ends = np.cumsum(block_words.astype(np.int64))
    at, filled = ends - block_words, np.zeros(blocks, np.int64)
    active = np.nonzero(at < ends)[0]
    counts = np.array(COUNTS)
    while len(active):
        word = words[at[active]]
        selector = (word >> np.uint64(60)).astype(np.int64)
        for kind in np.unique(selector).tolist():
            rows = active[selector == kind]
            if kind == 0:
                out[rows, filled[rows]] = words[at[rows] + 1]
                at[rows] += 1
                continue
            count, width = COUNTS[kind], WIDTHS[kind]
            mask = np.uint64((1 << width) - 1)
            shifts = (np.arange(count) * width).astype(np.uint64)
            values = (word[selector == kind][:, None] >> shifts) & mask
            out[rows[:, None], filled[rows][:, None] + np.arange(count)] = values
        filled[active] += counts[selector]
        at[active] += 1
        active = active[at[active] < ends[active]]
    return out[:, :BLOCK].ravel()[:n]


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, remembering the ids of words.

    No token of this vocabulary crosses white space, so a text's ids are those of its
    space-separated words in turn.  A word of characters that fold by a table (ASCII and
    Latin-1) is split by the vocabulary's own pattern and goes to the library's BPE model;
    any other word, and one that holds an added token, goes through the whole library.
    """

    def __init__(self, path: str, remembered: int = 200_000):
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        steps = parts["pre_tokenizer"]["pretokenizers"]
        # the library finds these in a text before it splits it, some of them after folding
        self.added = [token["content"].lower() for token in parts["added_tokens"]]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        marks = {b: chr(256 + i) for i, b in enumerate(others)}  # of bytes without a sign of their own
        self.signs = "".join([marks.get(b, chr(b)) for b in range(256)])  # of each byte
        self.codes = [struct.pack("<I", i) for i in range(self.library.get_vocab_size())]
        self.foldable = regex.compile("[!-~\xa1-\xff]*").fullmatch
        self.limit, self.words = remembered, _Words(self)

    def _pieces(self, text: str) -> bytes:
        low = text.lower()
        if self.foldable(text):
            # letters alone are one piece, and no added token
            if text.isalpha():
                return self.piece(low)
            if not any([token in low for token in self.added]):
                pieces = self.pieces(low)
                if len(pieces) == 1:
                    return self.piece(pieces[0])
                # a piece has the same ids as a word of its own
                return b"".join([self.words[piece.encode()] for piece in pieces])
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        """Ids of a folded piece."""
        if not piece.isascii():
            piece = codecs.charmap_decode(piece.encode(), "strict", self.signs)[0]
        codes = self.codes
        return b"".join([codes[token.id] for token in self.model.tokenize(piece)])

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers; NULL counts as empty."""
        return self.encode_all(pa.array([text], pa.binary()).cast(pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column; NULL counts as empty.

        The words are told apart in Arrow, so each is looked up once for all its places in the column.
        """
        if len(self.words) > self.limit:
            self.words.turn()
        low = pc.ascii_lower(texts)
        for token in self.added:
            # letters of an added token must stay as they are
            low = pc.if_else(pc.match_substring(texts, token, ignore_case=True), texts, low)
        lists = pc.ascii_split_whitespace(low)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        words = lists.flatten().dictionary_encode()
        if not len(words):
            return [np.zeros(0, "<u4") for _ in sizes]
        found = map(self.words.__getitem__, _spelt(words.dictionary))
        ids = pa.array(found, pa.binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[np.cumsum(sizes)] // 4
        return np.split(np.frombuffer(ids.buffers()[2], "<u4", ends[-1]), ends[:-1])


def _spelt(words: pa.Array) -> list[bytes]:
    """The bytes of each of some words, none of them NULL, cut from their buffer."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes()
    return [data[start:end] for start, end in zip(ends, ends[1:])]


class _Words(dict):
    """Ids by word, found when first asked for; words of the last generation are taken over when asked for again."""

    def __init__(self, tokenizer: WordTokenizer):
        super().__init__()
        self.piece, self.pieces = tokenizer.piece, tokenizer._pieces
        self.last: dict[bytes, bytes] = {}

    def turn(self) -> None:
        """Begin a generation."""
        self.last = dict(self)
        self.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.last.get(word)
        if ids is not None:
            pass
        elif word.isalpha():
            ids = self.piece(word.decode().lower())
        elif word[-1:] in b".," and word[-2:-1].isalnum():
            # a full stop or comma after a letter or digit is a piece of its own
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            text = word.decode()
            if len(text) > 1 and text[-1] in ".," and text[-2].isalpha():
                ids = self[word[:-1]] + self[word[-1:]]
            else:
                ids = self.pieces(text)
        self[word] = ids
        return ids


def load_words() -> WordTokenizer:
    """The public vocabulary with word ends."""
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def encode(docs: DataFrame, end_id: int = 1, load: Callable[[], WordTokenizer] = load_words) -> DataFrame:
    """``doc_id, n_tokens, words, block_words``: the packed ids of each ``doc_id, text``, ``end_id`` last."""
    end = np.array([end_id], "<u4")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_by_worker(load)
        for batch in batches:
            ids = [np.concatenate([found, end]) for found in tokenizer.encode_all(batch.column(1))]
            words, blocks = pack(ids)
            yield pa.record_batch([
                batch.column(0), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([w.tobytes() for w in words], pa.binary()),
                pa.array([b.astype("<i4").tobytes() for b in blocks], pa.binary()),
            ], ["doc_id", "n_tokens", "words", "block_words"])

    return docs.select("doc_id", "text").mapInArrow(
        packed, "doc_id bigint, n_tokens bigint, words binary, block_words binary")


_FILE = (
    "part int, row int, start bigint, doc_ids array<bigint>, n_tokens array<bigint>, "
    "n_blocks array<int>, block_words binary, words binary"
)


def write(docs: DataFrame, path: str, load: Callable[[], WordTokenizer] = load_words) -> None:
    """Write the ids of ``doc_id, text`` as file rows below ``path``, in ascending id order.

    Documents are dealt out by ranges of their order, as many as the session has shuffle
    partitions, and encoded where they arrive.  A NULL id comes first; rows of equal ids are
    ordered by a hash of their text, and may be spread over ranges.  ``start`` in a file row
    counts from the start of its range; the ranges follow each other by ``part``.
    """
    # the number tells equal rows apart, so that they can be spread too
    numbered = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    keys = [F.col("doc_id").asc_nulls_first(), "hash", "number"]
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, start, size = None, 0, 0, 0
        held: list[tuple] = []

        def flush():
            ids, counts, words, blocks = zip(*held)
            return pa.record_batch([
                pa.array([part], pa.int32()), pa.array([row], pa.int32()), pa.array([start], pa.int64()),
                pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(counts)], pa.list_(pa.int64())),
                pa.array([[len(b) // 4 for b in blocks]], pa.list_(pa.int32())),
                pa.array([b"".join(blocks)]), pa.array([b"".join(words)]),
            ], [field.split()[0] for field in _FILE.split(", ")])

        for batch in batches:
            for number, *doc in zip(*[column.to_pylist() for column in batch.columns]):
                if held and (number != part or size >= ROW_BYTES):
                    yield flush()
                    start, row = start + sum(doc[1] for doc in held), row + 1
                    held, size = [], 0
                if number != part:
                    part, row, start = number, 0, 0
                held.append(tuple(doc))
                size += len(doc[2])
        if held:
            yield flush()

    (
        encode(dealt, load=load).withColumn("part", F.spark_partition_id())
        .select("part", "doc_id", "n_tokens", "words", "block_words")
        .mapInArrow(rows, _FILE).write.parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (array of int) of every document of the files below ``path``."""
    from pyspark.sql import Window

    files = spark.read.schema(_FILE).parquet(path)
    totals = files.groupBy("part").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda s, n: s + n)).alias("n"))
    # one row per range
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if totals.count() <= BROADCAST_IDS:
        base = F.broadcast(base)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 32):
                rows = batch.slice(first, 32).to_pylist()
                sizes = np.concatenate([np.frombuffer(row["block_words"], "<i4") for row in rows])
                words = np.frombuffer(b"".join(row["words"] for row in rows), "<u8")
                ids = unpack(words, sizes, len(sizes) * BLOCK)
                counts = np.array([n for row in rows for n in row["n_tokens"]], np.int64)
                blocks = np.array([n for row in rows for n in row["n_blocks"]], np.int64)
                ends = np.cumsum(counts)
                inner = np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (ends - counts), counts)
                values = ids[inner + np.arange(len(inner))].astype(np.int32)
                parts = [row["part"] for row in rows for _ in row["doc_ids"]]
                starts = [row["start"] + np.cumsum([0, *row["n_tokens"][:-1]]) for row in rows]
                yield pa.record_batch([
                    pa.array(parts, pa.int32()),
                    pa.array([doc_id for row in rows for doc_id in row["doc_ids"]], pa.int64()),
                    pa.array(np.concatenate(starts).astype(np.int64)), pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values)),
                ], ["part", "doc_id", "start", "n_tokens", "ids"])

    found = files.mapInArrow(
        documents, "part int, doc_id bigint, start bigint, n_tokens bigint, ids array<int>")
    return found.join(base, "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def ids_crc32(ids: str) -> Column:
    """crc32 of a column of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def checked(ids: pa.Array) -> pa.Array:
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64())

    return checked(ids)
