"""N-gram Jaccard join with signature trees; exact, for similarities of 4/5 or more.

A document is its set of distinct five-word shingles, as 64-bit hashes.  Two documents
link when their sets overlap by at least four fifths of their union.

1. ``profile`` reads every text once: set size, a digest of the set, a bitmap of its
   shingles, and the part of the set that any linked set must meet (the rarest-first
   prefix).  Documents of equal sets become one class and are never compared.
2. Classes that share a prefix shingle form a block.  Shingles that are frequent in the
   corpus come last in the prefix order, so a passage in many documents forms blocks
   only of documents that are made of such passages.
3. Every class is compared with the smallest class it shares a block with, by bitmap and
   then by set.  Most groups of near copies are one label after this, and done.
4. The other blocks are searched by signature trees: nodes hold the OR of their members'
   bitmaps, a size range and, where all agree, the label.  Two nodes are walked together
   and left where sizes, labels or the largest possible overlap rule out a link.
5. Pairs that are left are compared by their sets, and links become components.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiflux.llm.common import by_ids
from epiflux.session import stored

#: Words in a shingle.
WIDTH = 5
#: Most frequent shingles that are told apart from rare ones; they go to every task.
HOT_SHINGLES = 65_536
#: A shingle is frequent above this share of all documents.
HOT_SHARE = 0.002
#: And in at least so many documents.
HOT_DOCS = 64
#: Most classes of a block that one task searches; larger blocks are searched in pieces.
BLOCK_CLASSES = 2_048
_WORDS_BYTES = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACES = b" \t\n\x0b\x0c\r"


def _word_hashes(text: str) -> np.ndarray:
    """Hashes of the words with A-Z lower-cased, reading some megabytes at a time."""
    from xxhash import xxh3_64_intdigest

    raw, start, parts = text.encode().lower(), 0, []
    while start < len(raw):
        end = min(len(raw), start + _WORDS_BYTES)
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        words = raw[start:end].split()
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle are one, no words none."""
    words = _word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for at in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + words[at:at + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def prefix_size(size: int) -> int:
    """Shingles of a set, in any fixed order, of which a linked set has at least one in its own prefix."""
    return size - (4 * size + 4) // 5 + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit per shingle by its hash; two to four bits of room for each, a power of two in all."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[((shingles >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two sorted sets overlap by four fifths of their union."""
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    if not len(small) or 5 * len(small) < 4 * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= 80 * (len(small) + len(large) - common)


_PROFILE = (
    "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, prefix binary, bits binary, "
    "hot bigint, hot_docs bigint"
)


def profile(docs: DataFrame) -> DataFrame:
    """A row per document of ``doc_id, text``, and rows ``hot, hot_docs`` of frequent shingles.

    Frequent shingles are counted over the distinct sets of a batch.  The count only
    decides an order and need not be exact.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        counted = 0

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= max(min(8, HOT_DOCS), 2 * HOT_SHARE * counted)
            held.clear()
            seen.clear()
            n, none = int(some.sum()), pa.nulls
            return pa.record_batch([
                none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()),
                none(n, pa.binary()), none(n, pa.binary()),
                pa.array(values[some].view(np.int64)), pa.array(counts[some].astype(np.int64)),
            ], names)

        names = [field.split()[0] for field in _PROFILE.split(", ")]
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = shingle_set(text.as_py())
                size = len(shingles)
                row = (doc_id, size, None, None, None, None)
                if size:
                    digest = xxh3_128_digest(shingles.tobytes())
                    prefix = shingles[:prefix_size(size)].tobytes()
                    row = (doc_id, size, *struct.unpack("<qq", digest), prefix, bitmap(shingles))
                    counted += 1
                    if digest not in seen:
                        seen.add(digest)
                        held.append(shingles)
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            n = batch.num_rows
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.nulls(n, pa.int64())] * 2, names
            )
            if sum(map(len, held)) > 1_000_000:
                yield frequent()
                counted = 0
        if held:
            yield frequent()

    return docs.select("doc_id", "text").mapInArrow(read, _PROFILE)


def _ordered_prefix(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    frequent = np.isin(shingles, hot)
    return np.concatenate([shingles[~frequent], shingles[frequent]])[:prefix_size(len(shingles))]


def _keys(classes: DataFrame, docs: DataFrame, hot: np.ndarray, hot_counts: np.ndarray) -> DataFrame:
    """``key, rep, part`` for each prefix shingle of each class, frequent shingles last in the order.

    The rows of a frequent key are dealt into parts.  Each row passes one Python worker, as
    each further one in a task takes memory of its own.
    """
    # a thousand rows of a frequent key to a task
    parts = np.maximum(1, hot_counts // 1_000)

    def frequent(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([bool(np.isin(np.frombuffer(p, np.uint64), hot).any()) for p in batch.to_pylist()])

    def dealt(reps: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.uint64), *found])
        reps = np.repeat(reps, [len(f) for f in found])
        part = np.zeros(len(keys), np.int32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            wide = hot[at] == keys
            part[wide] = reps[wide] % parts[at[wide]]
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(reps), pa.array(part)], ["key", "rep", "part"])

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(p, np.uint64) for p in batch.column(1).to_pylist()]
            plain = np.array([not np.isin(f, hot).any() for f in found], bool)
            yield dealt(batch.column(0).to_numpy()[plain], [f for f, own in zip(found, plain) if own])

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_ordered_prefix(shingle_set(t.as_py()), hot) for t in batch.column(1)]
            yield dealt(batch.column(0).to_numpy(), found)

    schema = "key bigint, rep bigint, part int"
    plain = classes.select("rep", "prefix").mapInArrow(exploded, schema)
    if not len(hot):
        return plain
    marked = classes.withColumn("frequent", F.arrow_udf(frequent, "boolean")("prefix"))
    again = stored(marked.filter("frequent").select("rep"), "jaccard-reread")
    texts = by_ids(docs.select("doc_id", "text"), "doc_id", again, "left_semi").select("doc_id", "text")
    return plain.unionByName(texts.mapInArrow(reread, schema))


_MEMBERS = "block bigint, rep bigint, pivot bigint"


def _blocks(keys: DataFrame, hot: np.ndarray) -> DataFrame:
    """``block, rep, pivot``: classes that share a key, one block for keys of the same classes.

    The parts of a frequent key go to several tasks; such a key, and any other of more
    than ``BLOCK_CLASSES`` classes, is a block by itself, without a pivot.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        known: set[int] = set()

        def groups(keys: np.ndarray, reps: np.ndarray):
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (reps[1:] != reps[:-1])
            keys, reps = keys[fresh], reps[fresh]
            starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
            ends = np.r_[starts[1:], len(keys)]
            wide = np.isin(keys[starts].view(np.uint64), hot)
            some = (ends - starts > 1) | wide
            blocks, members, pivots = [], [], []
            for a, b, own in zip(starts[some].tolist(), ends[some].tolist(), wide[some].tolist()):
                part = reps[a:b]
                if own or b - a > BLOCK_CLASSES:
                    blocks.append(np.full(b - a, keys[a]))
                    pivots.append(np.full(b - a, np.iinfo(np.int64).min))
                else:
                    block = xxh3_64_intdigest(part.tobytes())
                    if block in known:
                        continue
                    if len(known) < 1_000_000:
                        known.add(block)
                    blocks.append(np.full(b - a, block, np.uint64).view(np.int64))
                    pivots.append(np.full(b - a, part[0]))
                members.append(part)
            if members:
                pivot = np.concatenate(pivots)
                yield pa.record_batch([
                    pa.array(np.concatenate(blocks)), pa.array(np.concatenate(members)),
                    pa.array(pivot, mask=pivot == np.iinfo(np.int64).min),
                ], ["block", "rep", "pivot"])

        left_keys, left_reps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([left_keys, batch.column(0).to_numpy()])
            reps = np.concatenate([left_reps, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            left_keys, left_reps = keys[cut:], reps[cut:]
            if cut:
                yield from groups(keys[:cut], reps[:cut])
        if len(left_keys):
            yield from groups(left_keys, left_reps)

    return (
        keys.repartition("key", "part")
        .sortWithinPartitions("key", "rep").select("key", "rep").mapInArrow(runs, _MEMBERS)
    )


class Node:
    """A signature tree: a member, or up to eight nodes, with what their pairs are judged by."""

    __slots__ = ("children", "member", "low", "high", "bits", "label", "forms")

    def __init__(self, children: list[Node], member=None):
        self.children, self.member = children, member
        if member is None:
            self.low = min(child.low for child in children)
            self.high = max(child.high for child in children)
            self.bits = min(child.bits for child in children)
            labels = {child.label for child in children}
            self.label = labels.pop() if len(labels) == 1 else None
            self.forms: dict[int, tuple[int, int]] = {}
        else:
            rep, size, raw, label = member
            value = int.from_bytes(raw, "little")
            self.low = self.high = size
            self.bits, self.label = 8 * len(raw), label
            self.forms = {self.bits: (value, size - value.bit_count())}

    def form(self, bits: int) -> tuple[int, int]:
        """OR of the bitmaps folded to ``bits``, and the most shingles that share a bit."""
        if bits not in self.forms:
            if self.member is None:
                parts = [child.form(bits) for child in self.children]
                value, shared = 0, 0
                for part, hidden in parts:
                    value |= part
                    shared = max(shared, hidden)
            else:
                value, width = self.forms[self.bits][0], self.bits
                while width > bits:
                    width //= 2
                    value = (value >> width) | (value & ((1 << width) - 1))
                shared = self.low - value.bit_count()
            self.forms[bits] = value, shared
        return self.forms[bits]


def build_tree(members: list[tuple]) -> Node:
    """Tree over ``(rep, size, bitmap, label)``, neighbours in size together."""
    level = [Node([], m) for m in sorted(members, key=lambda m: (m[1], m[3], m[0]))]
    while len(level) > 1:
        level = [Node(level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0]


def may_link(x: Node, y: Node) -> bool:
    """Whether some pair of two nodes can still link."""
    if x.label is not None and x.label == y.label:
        return False
    if 5 * x.high < 4 * y.low or 5 * y.high < 4 * x.low:
        return False
    needed = max(-(-4 * max(x.low, y.low) // 5), -(-4 * (x.low + y.low) // 9))
    bits = min(x.bits, y.bits)
    (a, hidden_a), (b, hidden_b) = x.form(bits), y.form(bits)
    return (a & b).bit_count() + min(hidden_a, hidden_b) >= needed


def search(root: Node) -> Iterator[tuple[int, int]]:
    """Pairs of different labels that the bitmaps cannot rule out, by walking the tree against itself."""
    pending = [(root, root)]
    while pending:
        x, y = pending.pop()
        if x is y:
            if x.member is None and x.label is None:
                nodes = x.children
                pending += [(a, b) for i, a in enumerate(nodes) for b in nodes[i:]]
        elif may_link(x, y):
            if x.member is not None and y.member is not None:
                a, b = x.member[0], y.member[0]
                yield (a, b) if a < b else (b, a)
            elif y.member is not None or (x.member is None and x.high - x.low >= y.high - y.low):
                pending += [(child, y) for child in x.children]
            else:
                pending += [(x, child) for child in y.children]


def _searched(rows: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b`` of the blocks ``block, rep, n_shingles, bits, label``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(members: list[tuple]):
            chunk: list[tuple[int, int]] = []
            for pair in search(build_tree(members)):
                chunk.append(pair)
                if len(chunk) == 50_000:
                    yield as_batch(chunk)
                    chunk = []
            if chunk:
                yield as_batch(chunk)

        def as_batch(chunk):
            both = np.array(chunk, np.int64)
            return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        current, members = None, []
        for batch in batches:
            for block, *member in zip(*[column.to_pylist() for column in batch.columns]):
                if block != current and members:
                    yield from pairs(members)
                    members = []
                current = block
                members.append(tuple(member))
        if members:
            yield from pairs(members)

    return (
        rows.repartition("block").sortWithinPartitions("block")
        .select("block", "rep", "n_shingles", "bits", "label").mapInArrow(walk, "a bigint, b bigint")
    )


def _pieces(large: DataFrame) -> DataFrame:
    """Blocks of bounded size that hold every pair of different labels of a large block.

    The rows of the block's most frequent label never need each other.  They are cut
    into pieces, the other rows too, and each piece of the others meets itself, the
    pieces after it and every piece of the frequent label.
    """
    half = BLOCK_CLASSES // 2
    by_label = large.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
    shape = by_label.groupBy("block").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")
    ).filter("n_all > n_main")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / half)).cast("int")
    shape = shape.withColumn("n_rest", F.expr("n_all - n_main")).select(
        "block", "main", parts("n_main").alias("p_main"), parts("n_rest").alias("p_rest")
    )
    rows = large.join(shape, "block")
    is_main = F.col("label") == F.col("main")
    place = F.pmod(F.xxhash64("rep"), F.when(is_main, F.col("p_main")).otherwise(F.col("p_rest"))).cast("int")
    rest = F.sequence(F.lit(0), F.col("p_rest") - 1)
    with_main = F.transform(F.sequence(F.lit(0), F.col("p_main") - 1), lambda j: F.struct(
        F.lit(1).alias("kind"), F.col("place").alias("i"), j.alias("j")))
    with_rest = F.transform(rest, lambda j: F.struct(
        F.lit(0).alias("kind"), F.least("place", j).alias("i"), F.greatest("place", j).alias("j")))
    main_side = F.transform(rest, lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("place").alias("j")))
    return (
        rows.withColumn("place", place)
        .withColumn("to", F.explode(F.when(is_main, main_side).otherwise(F.concat(with_main, with_rest))))
        .withColumn("block", F.xxhash64("block", "to.kind", "to.i", "to.j"))
        .select("block", "rep", "n_shingles", "bits", "label")
    )


def _plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that sizes and bitmaps do not rule out."""

    @F.arrow_udf("boolean")
    def possible(size_a: pa.Array, bits_a: pa.Array, size_b: pa.Array, bits_b: pa.Array) -> pa.Array:
        rows = zip(*[column.to_pylist() for column in (size_a, bits_a, size_b, bits_b)])
        return pa.array([may_link(Node([], (0, m, x, 0)), Node([], (1, n, y, 1))) for m, x, n, y in rows], pa.bool_())

    left, right = (
        info.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        for side in "ab"
    )
    fair = F.expr("5 * n_a >= 4 * n_b AND 5 * n_b >= 4 * n_a")
    both = pairs.join(right, "b").join(left, "a").filter(fair)
    return both.filter(possible("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the written pairs ``a, b`` those whose sets link; sets are made anew from the texts of the pairs."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py()).tobytes() for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["rep", "shingles"])

    @F.arrow_udf("boolean")
    def link(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([
            linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
            for a, b in zip(left.to_pylist(), right.to_pylist())
        ], pa.bool_())

    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "jaccard-wanted")
    texts = by_ids(docs, "doc_id", wanted, "left_semi").select("doc_id", "text")
    sets = stored(texts.mapInArrow(sets_of, "rep bigint, shingles binary"), "jaccard-sets")
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(right, "b").join(left, "a").filter(link("left", "right")).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``rep, component_id``: the smallest node reachable, for every node of the links ``a, b``.

    Alternates two joins: neighbours above a node move to its smallest neighbour, then
    neighbours below it do, until nothing moves.  Each round is a written table.
    """
    edges = stored(links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("u <> v").distinct(), "components")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        edges = stored(small, "components")
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    return edges.select(F.col("u").alias("rep"), F.col("v").alias("component_id"))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    NULL, empty and blank texts have no shingles and link with nothing.  Rows that share
    an id count as linked.  A row with a NULL id links like any other, but lends its id to
    no component; a class of such rows only has a NULL component.
    """
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    read = stored(profile(docs), "jaccard-profile")
    rows = read.filter("n_shingles IS NOT NULL")
    n_rows = rows.count()
    hot_rows = (
        read.filter("hot IS NOT NULL").groupBy("hot").agg(F.sum("hot_docs").alias("n"))
        .filter(F.col("n") >= max(HOT_DOCS, HOT_SHARE * n_rows)).orderBy(F.desc("n"), "hot").limit(HOT_SHINGLES).collect()
    )
    hot = np.array([row.hot for row in hot_rows], np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, counts = hot[order], np.array([row.n for row in hot_rows], np.int64)[order]
    classes = stored(
        rows.filter("c1 IS NOT NULL").groupBy("c1", "c2").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
            F.first("prefix").alias("prefix"), F.first("bits").alias("bits"),
        ), "jaccard-classes",
    )
    named = classes.filter("rep IS NOT NULL")
    members = stored(_blocks(_keys(named, docs, hot, counts), hot), "jaccard-members")
    lead = members.filter("pivot IS NULL").groupBy("block").agg(F.min("rep").alias("lead"))
    stars = (
        members.filter("pivot IS NOT NULL").groupBy("rep").agg(F.min("pivot").alias("pivot"))
        .unionByName(
            members.filter("pivot IS NULL").join(lead, "block").groupBy("rep").agg(F.min("lead").alias("pivot"))
        ).groupBy("rep").agg(F.min("pivot").alias("pivot"))
    )
    info = named.select("rep", "n_shingles", "bits")
    near = stored(_plausible(
        stars.filter("pivot <> rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")), info), "jaccard-pairs")
    first = stored(_verified(near, docs), "jaccard-links")
    labels = first.groupBy("b").agg(F.min("a").alias("label")).withColumnRenamed("b", "rep")
    labelled = stored(members.join(labels, "rep", "left").select(
        "block", "rep", F.coalesce("label", "rep").alias("label"), F.col("pivot").isNull().alias("large")
    ).distinct(), "jaccard-labelled")
    open_blocks = labelled.groupBy("block", "large").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("block", "large")
    rest = labelled.join(open_blocks, ["block", "large"]).join(info, "rep")
    pairs = _searched(
        rest.filter("NOT large").select("block", "rep", "n_shingles", "bits", "label")
        .unionByName(_pieces(rest.filter("large")))
    ).distinct()
    second = stored(_verified(stored(pairs, "jaccard-pairs"), docs), "jaccard-links")
    found = components(first.unionByName(second))
    return (
        rows.select("doc_id", "n_shingles", "c1", "c2")
        .join(classes.select("c1", "c2", "rep"), ["c1", "c2"], "left")
        .join(found, "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce(
            "component_id", "rep", F.when(F.col("c1").isNull(), F.col("doc_id"))).alias("component_id"))
    )
