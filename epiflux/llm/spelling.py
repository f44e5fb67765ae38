"""Spelling variants: words one edit apart, found with bidirectional FM-indexes.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.
One edit leaves the first or the last half of a word whole, which gives two search schemes:
match the first half exactly from the left and extend over the second with one error, or
match the last half exactly from the right and extend over the first.  A bidirectional
FM-index of the text ``$word$word$...$`` does both: it holds the Burrows-Wheeler transforms
of the text and of its reverse, and two intervals of suffix ranks that an extension to the
left or to the right narrows together.  A pattern that has grown to ``$word$`` is one row
of the first index, and its rank there is the rank of the word.

The vocabulary is cut into shards of bounded size, each with an index of its own.  A word
stands in the shard of (length, first half) and in that of (length, last half), and a search
asks only shards of its own halves for the lengths one less, the same and one more.  Halves
that many words share are dealt out over several shards; shards that many words ask are
searched in several tasks.  No word is compared with all others, and nothing is gathered.

Edge cases: NULL and empty texts have no words, a NULL id counts as an empty one; repeated
rows count as often as they occur; of near words with the same count the smallest in
code-point order is taken; an empty table gives no rows; texts of any length are read
whole; other columns are ignored whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiflux.session import stored

#: Words of an index, and searches that one task makes in it, about.
SHARD_WORDS = 20_000
SHARD_SEARCHES = 120_000

#: Searches side by side.
_SIDE_BY_SIDE = 8_192

#: Signs of the text that are no letters.
_END, _MARK, _LETTERS = 0, 1, 2


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling the length that is compared."""
    n, width = len(text), 1
    rank = text.astype(np.int64)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        key = rank * (max(n, int(rank.max(initial=0)) + 1) + 1) + behind
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        width *= 2


class Ranks:
    """Counts of signs in beginnings of a Burrows-Wheeler transform."""

    WINDOW = 32

    def __init__(self, text: np.ndarray, signs: int):
        order = suffix_order(text)
        self.bwt = text[order - 1]  # the first suffix is preceded by the end of the text
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=signs))])
        windows = len(text) // self.WINDOW + 1
        padded = np.full(windows * self.WINDOW, signs, text.dtype)
        padded[: len(text)] = self.bwt
        self.windows = padded.reshape(windows, self.WINDOW)
        which = np.repeat(np.arange(windows), self.WINDOW)[: len(text)]
        counts = np.zeros((windows + 1, signs + 1), np.int32)
        np.add.at(counts, (which + 1, self.bwt.astype(np.int64) + 1), 1)
        self.before = counts.cumsum(axis=0).cumsum(axis=1)  # signs below a sign, before a window

    def counts(self, sign: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences before ``at`` of signs below ``sign``, and of ``sign``."""
        window, rest = np.divmod(at, self.WINDOW)
        seen = self.windows[window]
        inside = np.arange(self.WINDOW) < rest[:, None]
        below = self.before[window, sign] + (inside & (seen < sign[:, None])).sum(axis=1)
        equal = self.before[window, sign + 1] - self.before[window, sign] + (inside & (seen == sign[:, None])).sum(axis=1)
        return below, equal


class States:
    """Patterns that occur: the search each belongs to, its intervals in both indexes and their size."""

    def __init__(self, of, low, other, size):
        self.of, self.low, self.other, self.size = of, low, other, size

    def __len__(self):
        return len(self.of)

    def __getitem__(self, which):
        return States(self.of[which], self.low[which], self.other[which], self.size[which])

    def __add__(self, more: States) -> States:
        pairs = zip(vars(self).values(), vars(more).values())
        return States(*[np.concatenate(pair) for pair in pairs])


class BidirectionalIndex:
    """FM-indexes of a vocabulary in code-point order, forwards and backwards."""

    def __init__(self, words: list[str]):
        letters = sorted(set("".join(words)))
        self.signs = {letter: at for at, letter in enumerate(letters, _LETTERS)}
        self.alphabet = len(letters) + _LETTERS
        coded = self.code(words)
        self.words, self.lengths = coded, np.array([len(word) for word in words])
        text = np.full(int((self.lengths + 1).sum()) + 2, _MARK, np.uint16)
        inside = coded > 0
        starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]) + 1
        text[(starts[:, None] + np.arange(coded.shape[1]))[inside]] = coded[inside]
        text[-1] = _END
        backwards = np.concatenate([text[-2::-1], text[-1:]])
        # a pattern grows to the left in the index of the text, to the right in that of its reverse
        self.to_left, self.to_right = Ranks(text, self.alphabet), Ranks(backwards, self.alphabet)

    def code(self, words: list[str]) -> np.ndarray:
        """Words as rows of signs, filled up with 0; letters that no word of the index has are ``alphabet``."""
        width = max(map(len, words), default=0)
        points = np.frombuffer("".join(word.ljust(width, "\0") for word in words).encode("utf-32-le"), np.uint32)
        known = np.array([0, *map(ord, self.signs)], np.uint32)
        codes = np.array([0, *self.signs.values()], np.int64)
        at = np.minimum(np.searchsorted(known, points), len(known) - 1)
        return np.where(known[at] == points, codes[at], self.alphabet).reshape(len(words), width)

    def extend(self, states: States, sign: np.ndarray, ranks: Ranks) -> States:
        """The states with one more sign, as far as the pattern occurs.  ``low`` is the interval in ``ranks``."""
        known = sign < self.alphabet
        states, sign = states[known], sign[known]
        below, equal = ranks.counts(sign, states.low)
        below_end, equal_end = ranks.counts(sign, states.low + states.size)
        grown = States(
            states.of, ranks.first[sign] + equal, states.other + below_end - below, equal_end - equal)
        return grown[grown.size > 0]

    def followers(self, states: States, ranks: Ranks, but: np.ndarray) -> States:
        """The states with each letter that can follow, except the letter in ``but``."""
        few = states.size <= self.alphabet
        narrow = np.flatnonzero(few)
        sizes = states.size[narrow]
        of = np.repeat(narrow, sizes)
        step = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = of * self.alphabet + ranks.bwt[states.low[of] + step]
        wide = np.flatnonzero(~few)
        key = np.unique(np.concatenate([key, (wide[:, None] * self.alphabet + np.arange(self.alphabet)).ravel()]))
        of, sign = np.divmod(key, self.alphabet)
        wanted = (sign >= _LETTERS) & (sign != but[of])
        return self.extend(states[of[wanted]], sign[wanted], ranks)

    def near(self, words: np.ndarray, exact: int, length: int, from_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ``words`` and of the index's words of ``length`` that are one edit from them.

        ``words`` are rows of signs of one length, of which the first ``exact`` are matched
        exactly from the left (or the last ones from the right).  The edit is made where the
        words differ first in that direction, so each pair is found once.
        """
        ranks = self.to_right if from_left else self.to_left
        words = words if from_left else words[:, ::-1]
        n, width = words.shape
        whole = States(*[np.array([x]) for x in (0, 0, 0, len(ranks.bwt))])
        mark = self.extend(whole, np.array([_MARK]), ranks)
        zero = States(np.arange(n), *[np.repeat(x, n) for x in (mark.low, mark.other, mark.size)])
        for at in range(exact):
            zero = self.extend(zero, words[zero.of, at], ranks)
        edited = zero[:0]
        never = np.full(n, -1)
        for at in range(exact, width + 1):
            after = words[:, at] if at < width else never
            if length == width + 1:  # a letter more than the word has
                edited = edited + self.followers(zero, ranks, after[zero.of])
            if at == width:
                break
            edited = self.extend(edited, after[edited.of], ranks)
            if length == width:
                edited = edited + self.followers(zero, ranks, after[zero.of])
            elif length == width - 1:  # of equal letters in a row the last goes
                last = words[:, at + 1] != after if at + 1 < width else np.ones(n, bool)
                edited = edited + zero[last[zero.of]]
            zero = self.extend(zero, after[zero.of], ranks)
        edited = self.extend(edited, np.full(len(edited), _MARK), ranks)
        row = edited.other if from_left else edited.low
        return edited.of, row - 2  # two suffixes stand before those of the words


def half(length: int) -> int:
    """Code points of the first half of a word."""
    return length // 2


def _search(entries: pd.DataFrame, searches: pd.DataFrame) -> pd.DataFrame:
    """Near words that one shard has for some searches: ``word, n_near, form_n, form`` of each search."""
    columns = ["word", "n_near", "form_n", "form"]
    if entries.empty or searches.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
    # which halves brought each word here; a word found by its other half is found elsewhere too
    sides = entries.groupby("word").agg(left=("left", "max"), right=("left", "min"), n=("n", "max"))
    words = sorted(sides.index)
    sides = sides.loc[words]
    here = {True: sides["left"].to_numpy(bool), False: ~sides["right"].to_numpy(bool)}
    n = sides["n"].to_numpy()
    index = BidirectionalIndex(words)
    names = np.array(words, object)
    out = []
    width = searches["word"].str.len()
    for (own, length, left), group in searches.groupby([width, "length", "left"]):
        kept = half(length)
        exact = kept if left else length - kept
        asked = group["word"].to_numpy(object)
        for begin in range(0, len(asked), _SIDE_BY_SIDE):
            part = asked[begin:begin + _SIDE_BY_SIDE]
            coded = index.code(list(part))
            of, found = index.near(coded, exact, length, bool(left))
            good = here[bool(left)][found]
            if not left:  # words with the same first half are found from the left
                good &= (coded[of, :kept] != index.words[found][:, :kept]).any(axis=1)
            of, found = of[good], found[good]
            order = np.lexsort((found, -n[found], of))
            of, found = of[order], found[order]
            which, first, count = np.unique(of, return_index=True, return_counts=True)
            best = found[first]
            out.append(pd.DataFrame({"word": part[which], "n_near": count, "form_n": n[best], "form": names[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=columns)


def vocabulary(docs: DataFrame, least: int = 3, shortest: int = 5) -> DataFrame:
    """``word, n``: words of ``doc_id, text`` with at least ``shortest`` letters and ``least`` occurrences.

    Words are runs of ``A-Z a-z`` and U+00C0 to U+00FF, A-Z in small letters.  Where 97 divides
    the checksum of ``doc_id:word``, the letter that the checksum points to is left out, which
    plants misspellings that tests and figures can tell.
    """
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(small, F.lit(f"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    every = docs.select(name.alias("name"), F.explode(runs).alias("run"))
    sum_ = F.crc32(F.concat("name", F.lit(":"), "run").cast("binary"))
    at = (F.col("sum") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = every.withColumn("sum", sum_).select(
        F.when(F.col("sum") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form_n, form``: number of near words, and the one with the largest count, of those that have any.

    ``words`` is a written table of distinct ``word, n``.
    """
    shards = max(1, -(-2 * words.count() // SHARD_WORDS))
    size = F.length("word")

    def halves():
        """Both halves of a word as if it had ``_length``: the last half is as long as that of such a word."""
        first, last = F.substring("word", F.lit(1), F.col("_kept")), F.expr("right(word, _length - _kept)")
        return F.array(*[
            F.struct(F.lit(left).alias("left"), F.xxhash64(F.lit(left), F.col("_length"), part).alias("key"))
            for left, part in ((True, first), (False, last))
        ])

    def with_keys(frame: DataFrame) -> DataFrame:
        cut = frame.withColumn("_kept", F.floor(F.col("_length") / 2).cast("int"))
        return cut.withColumn("_key", F.explode(halves())).select(
            "word", "n", F.col("_length").alias("length"), "_key.left", "_key.key")

    standing = with_keys(words.withColumn("_length", size))
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda x: x >= F.lit(2))
    asking = with_keys(words.withColumn("_length", F.explode(lengths)))

    # a half that many words share is dealt out over several shards
    common = stored(
        standing.groupBy("key").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") > SHARD_WORDS // 2).select(
            F.col("key").alias("common"), F.ceil(F.col("of") / (SHARD_WORDS // 2)).cast("int").alias("parts")),
        "spelling-halves")
    place = lambda part: F.pmod(F.xxhash64("key", part), F.lit(shards)).cast("int")
    parts = F.coalesce("parts", F.lit(1))

    def with_parts(frame: DataFrame) -> DataFrame:
        return frame.join(common, F.col("key") == F.col("common"), "left").withColumn("parts", parts)

    entries = with_parts(standing).select(
        place(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).alias("shard"), "word", "n", "left")
    every_part = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), place))
    searches = stored(with_parts(asking).select(
        F.explode(every_part).alias("shard"), "word", F.col("length").cast("int").alias("length"), "left"),
        "spelling-searches")

    # a shard that many words ask is searched by several tasks
    asked = searches.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_SEARCHES).cast("int").alias("tasks"))
    asked = stored(asked, "spelling-shards")
    entries = entries.join(asked, "shard").withColumn(
        "task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    searches = searches.join(asked, "shard").withColumn(
        "task", F.pmod(F.xxhash64("word"), F.col("tasks")).cast("int")).drop("tasks")
    keys = ["shard", "task"]
    found = entries.groupBy(*keys).cogroup(searches.groupBy(*keys)).applyInPandas(
        _search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.order")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words that have a ``form``: the word that following forms ends at.

    A form counts at least twice as often as its word, so chains end, after as many steps as
    the counts can double; each round doubles the steps that a word has gone.
    """
    gone = stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = gone.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = gone.join(on, F.col("root") == F.col("_word"), "left")
        if further.filter("_root IS NOT NULL").isEmpty():
            return gone
        gone = stored(further.select("word", F.coalesce("_root", "root").alias("root")), "spelling-roots")


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each of the distinct ``word, n``.

    The form is the near word of the largest count, if that is at least twice the word's own.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    known = words.join(near_words(words), "word", "left")
    good = F.col("form_n") >= 2 * F.col("n")
    forms = stored(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "spelling-forms")
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
