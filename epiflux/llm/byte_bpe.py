"""Byte-level BPE: encoding with a segment tree of pair ranks, and decoding.

Every match of the split pattern is encoded by itself.  A segment tree over its byte
positions holds, for each live token, the rank of the pair it forms with its right
neighbour; the root is the leftmost pair of lowest rank.  A merge drops one leaf and
renews the two leaves beside it, each in as many steps as the tree has levels.

Short matches of a batch are merged side by side: one tree per row of a numpy matrix.
Longer ones use one tree in a list.  Both follow the same rule and give the same ids.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiflux.llm.common import fresh

#: Texts longer than this are split into matches piece by piece, not as one list.
_LONG_TEXT = 1_000_000
#: Texts of about this many characters are encoded together.
_CHUNK_CHARS = 500_000
#: Matches whose ids a task remembers.
_REMEMBERED = 120_000
_NONE = 2**62
_SHIFT = 6  # a position within the widest matrix tree, 32 leaves


class ByteBpe:
    """Encoder and decoder for a table of byte strings and their ranks (which are the ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.table = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.remembered: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Ranks of pairs of ids, and their table; made when first asked for, as decoding has no use for them."""
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._index_pairs(pairs)
        return pairs

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        """Ranks from lines of a base64 byte string and a number."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``_NONE``: a lookup in an open table, probing on where keys collide."""
        keys = left << 32 | right
        if not self.pairs:
            return np.full(keys.shape, _NONE, np.int64)
        slots = self._slots(keys)
        held = self.slot_keys.take(slots)
        ranks = self.slot_ranks.take(slots)
        other = np.nonzero((held != keys) & (held >= 0))[0]
        while len(other):
            slots[other] = (slots[other] + 1) & (len(self.slot_keys) - 1)
            held[other] = self.slot_keys.take(slots[other])
            ranks[other] = self.slot_ranks.take(slots[other])
            other = other[(held[other] != keys[other]) & (held[other] >= 0)]
        return ranks

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.slot_keys).bit_length())).astype(np.int64)

    def _index_pairs(self, pairs: dict[int, int]) -> None:
        """Fill the open table, at most a quarter full; an empty slot has key -1 and no rank."""
        size = 1 << (4 * len(pairs) + 1).bit_length()
        self.slot_keys, self.slot_ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        keys = np.array(list(pairs), np.int64)
        for key, slot in zip(keys.tolist(), self._slots(keys).tolist()):
            while self.slot_keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.slot_keys[slot], self.slot_ranks[slot] = key, pairs[key]

    def _leaves(self, left, right, at) -> np.ndarray:
        """Leaf values: rank first, then position, so that a minimum is the leftmost."""
        ranks = self._pair_ranks(left, right)
        return np.where(ranks == _NONE, _NONE, (ranks << _SHIFT) | at)

    def _encode_side_by_side(self, pieces: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and their counts; each has 2 to ``leaves`` bytes.

        All matrices have a row per piece and are addressed by flat positions.
        """
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        inside = np.arange(leaves) < lengths[:, None]
        ids = np.zeros((count, leaves), np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((count, 2 * leaves), _NONE, np.int64)
        row, at = np.nonzero(inside[:, 1:])
        tree[row, at + leaves] = self._leaves(ids[row, at], ids[row, at + 1], at)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        following = np.tile(np.arange(1, leaves + 1), (count, 1)).ravel()
        before = np.tile(np.arange(-1, leaves - 1), (count, 1)).ravel()
        live, ids, tree = inside.ravel(), ids.ravel(), tree.ravel()
        levels = leaves.bit_length() - 1

        def put(base, at, value):
            node = at + leaves
            tree[base + node] = value
            for _ in range(levels):
                beside = tree.take(base + (node ^ 1))
                value = np.minimum(value, beside)
                node = node >> 1
                tree[base + node] = value

        row = np.nonzero(tree[1 :: 2 * leaves] != _NONE)[0]
        best = tree[row * (2 * leaves) + 1]
        while len(row):
            cells, base = row * leaves, row * (2 * leaves)
            left, merged = best & ((1 << _SHIFT) - 1), best >> _SHIFT
            right = following.take(cells + left)
            beyond = following.take(cells + right)
            ids[cells + left] = merged
            live[cells + right] = False
            following[cells + left] = beyond
            put(base, right, _NONE)
            value = np.full(len(row), _NONE, np.int64)
            on = np.nonzero(beyond < lengths.take(row))[0]
            where = cells[on] + beyond[on]
            before[where] = left[on]
            value[on] = self._leaves(merged[on], ids.take(where), left[on])
            put(base, left, value)
            back = before.take(cells + left)
            on = np.nonzero(back >= 0)[0]
            back = back[on]
            put(base[on], back, self._leaves(ids.take(cells[on] + back), merged[on], back))
            best = tree.take(base + 1)
            on = best != _NONE
            row, best = row[on], best[on]
        return ids[live], live.reshape(count, leaves).sum(axis=1)

    def _encode_alone(self, piece: bytes) -> list[int]:
        """Ids of one piece by one tree in a list."""
        pairs, length = self.pairs, len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        leaves = 1 << max(length - 2, 0).bit_length()
        shift = leaves.bit_length()
        none = 1 << 62
        tree = [none] * (2 * leaves)
        for at in range(length - 1):
            rank = pairs.get(ids[at] << 32 | ids[at + 1])
            if rank is not None:
                tree[leaves + at] = rank << shift | at
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        following, before = list(range(1, length + 1)), list(range(-1, length - 1))
        live = bytearray(b"\1") * length

        def put(at, value):
            node = at + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b
                if tree[node] == value:
                    return
                tree[node] = value

        while (best := tree[1]) != none:
            left, merged = best & ((1 << shift) - 1), best >> shift
            right = following[left]
            beyond = following[right]
            ids[left], live[right], following[left] = merged, 0, beyond
            if right < leaves:
                put(right, none)
            rank = None
            if beyond < length:
                before[beyond] = left
                rank = pairs.get(merged << 32 | ids[beyond])
            put(left, none if rank is None else rank << shift | left)
            if (back := before[left]) >= 0:
                rank = pairs.get(ids[back] << 32 | merged)
                put(back, none if rank is None else rank << shift | back)
        return list(itertools.compress(ids, live))

    def _learn(self, pieces: Iterable[str]) -> None:
        """Add the ids of matches not seen before to ``remembered``."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.remembered[piece] = whole.to_bytes(4, "little")
            elif len(raw) > 32:
                self.remembered[piece] = np.array(self._encode_alone(raw), "<i4").tobytes()
            else:
                groups.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for leaves, group in groups.items():
            ids, counts = self._encode_side_by_side([raw for _, raw in group], leaves)
            data, ends = ids.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
            start = 0
            for (piece, _), end in zip(group, ends):
                self.remembered[piece] = data[start:end]
                start = end

    def _matches(self, text: str) -> Iterator[list[str]]:
        if len(text) <= _LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = (match.group() for match in self.pattern.finditer(text))
        while part := list(itertools.islice(found, 200_000)):
            yield part

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; NULL counts as empty."""
        out: list[bytes] = []
        chunk: list[list[str]] = []
        chars = 0

        def flush():
            wanted = set().union(*chunk) if chunk else set()
            missing = [piece for piece in wanted if piece not in self.remembered]
            if len(self.remembered) + len(missing) > _REMEMBERED:
                self.remembered = {}
                missing = list(wanted)
            self._learn(missing)
            ids_of = self.remembered.__getitem__
            out.extend(b"".join(map(ids_of, pieces)) for pieces in chunk)
            chunk.clear()

        for text in texts:
            if text is not None and len(text) > _LONG_TEXT:
                flush()
                parts = []
                for pieces in self._matches(text):
                    chunk.append(pieces)
                    flush()
                    parts.append(out.pop())
                out.append(b"".join(parts))
                chars = 0
                continue
            chunk.append(self.pattern.findall(text) if text else [])
            chars += len(text or "")
            if chars >= _CHUNK_CHARS:
                flush()
                chars = 0
        flush()
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The byte string that the ids stand for."""
        return b"".join(map(self.table.__getitem__, ids))


def load_multi() -> ByteBpe:
    """The public ranks for many languages with their split pattern."""
    import public_tokenizers

    return ByteBpe.from_file(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", load: Callable[[], ByteBpe] = load_multi
) -> DataFrame:
    """Add ``ids`` (array of int), the token ids of ``text``; NULL and empty texts have no ids.

    Rows are independent: no shuffle, other columns stay on the JVM side.  ``load``
    makes the tokenizer once per task from files on every machine.
    """

    @F.arrow_udf("array<int>")
    def token_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load()
        for batch in batches:
            parts = tokenizer.encode(batch.to_pylist())
            ends = np.cumsum([0] + [len(part) // 4 for part in parts])
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return docs.withColumn(ids, token_ids(F.col(f"`{text}`")))


def decode(
    docs: DataFrame, ids: str = "ids", decoded: str = "decoded", load: Callable[[], ByteBpe] = load_multi
) -> DataFrame:
    """Add ``decoded`` (binary), the bytes of the token ids; NULL ids give NULL."""

    @F.arrow_udf("binary")
    def token_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load()
        for batch in batches:
            starts, values = batch.offsets.to_pylist(), batch.values.to_numpy(zero_copy_only=False)
            gone = batch.is_null().to_pylist()
            yield pa.array([
                None if none else tokenizer.decode(values[a:b].tolist())
                for a, b, none in zip(starts, starts[1:], gone)
            ], pa.binary())

    return docs.withColumn(decoded, token_bytes(F.col(f"`{ids}`")))


def encode_and_decode(
    docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", load: Callable[[], ByteBpe] = load_multi
) -> DataFrame:
    """``decode`` of ``encode`` in one pass of Python, so that a task holds one tokenizer in one worker."""
    both = fresh(docs, "_both")

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def there_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load()
        for batch in batches:
            parts = [np.frombuffer(part, "<i4") for part in tokenizer.encode(batch.to_pylist())]
            ends = np.cumsum([0, *map(len, parts)])
            values = pa.array(np.concatenate([np.zeros(0, "<i4"), *parts]), pa.int32())
            yield pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                pa.array([tokenizer.decode(part.tolist()) for part in parts], pa.binary()),
            ], ["ids", "decoded"])

    coded = docs.withColumn(both, there_and_back(F.col(f"`{text}`")))
    return coded.withColumns({ids: F.col(f"{both}.ids"), decoded: F.col(f"{both}.decoded")}).drop(both)
