"""Spelling variants against all pairs of words."""

import random
import re
import zlib

import numpy as np
import pytest
from oracle import compare

from epiflux.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best and counts[best] >= 2 * counts[word] else None

    def root(word):
        return root(form[word]) if form[word] else word

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def variants(rng, n):
    words = {"aaaaa", "aaaaaa", "aaaaaaa", "abababab", "ababababa", "babababa", "ÿÿÿÿÿ", "ÿÿÿÿÿÿ", "éclair", "eclair", "Éclair"}
    letters = "abcdé"
    while len(words) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
        words.add(word)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:],
                               word[:at] + rng.choice(letters) + word[at + 1:]])
            if len(word) >= 5:
                words.add(word)
    return {word: rng.choice([3, 4, 6, 8, 20, 50, 1000]) for word in sorted(words)}


@pytest.mark.parametrize("words, searches, n", [(20_000, 120_000, 700), (40, 50, 500), (6, 20, 200)])
def test_same_as_all_pairs(spark, monkeypatch, words, searches, n):
    monkeypatch.setattr(spelling, "SHARD_WORDS", words)
    monkeypatch.setattr(spelling, "SHARD_SEARCHES", searches)
    monkeypatch.setattr(spelling, "_SIDE_BY_SIDE", 64)
    counts = variants(random.Random(n), n)
    frame = spark.createDataFrame([(*item, "x") for item in counts.items()], "word string, n long, form string")
    got = {row.word: (row.form, row.root, row.n, row.n_near, row.form_n) for row in spelling.group_variants(frame).collect()}
    assert got == brute(counts)


def test_index_counts_and_intervals():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(60)})
    index = spelling.BidirectionalIndex(words)
    text = "$" + "$".join(words) + "$"
    for ranks in (index.to_left, index.to_right):
        signs = ranks.bwt.astype(int)
        for at in range(0, len(signs) + 1, 7):
            for sign in range(index.alphabet):
                below, equal = ranks.counts(np.array([sign]), np.array([at]))
                assert (below[0], equal[0]) == ((signs[:at] < sign).sum(), (signs[:at] == sign).sum())
    whole = spelling.States(*[np.array([x]) for x in (0, 0, 0, len(signs))])
    for pattern in ("ab", "a", "cab", "bca"):
        to_right = to_left = whole
        for letter in pattern:
            to_right = index.extend(to_right, np.array([index.signs[letter]]), index.to_right)
        for letter in reversed(pattern):
            to_left = index.extend(to_left, np.array([index.signs[letter]]), index.to_left)
        times = len(re.findall(f"(?={pattern})", text))
        assert (to_left.size.sum(), to_right.size.sum()) == (times, times)
        if times:  # both ways end at the same pair of intervals
            assert (to_right.low[0], to_right.other[0]) == (to_left.other[0], to_left.low[0])


def test_vocabulary(spark):
    rows = [(1, "Seven seven, SEVEN 7seven; four Ünder under"), (None, "seven ÜNDER"), (2, None), (3, ""),
            (1, "Seven seven, SEVEN 7seven; four Ünder under"), (4, "word " * 3 + "lengthy " * 100_000)]
    counts = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    frame = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, word int")
    got = {row.word: row.n for row in spelling.vocabulary(frame).collect()}
    assert got == {word: n for word, n in counts.items() if n >= 3}


def test_empty(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_query_matches_its_sql(spark, folder):
    name = "op11_spelling_variants"
    rows, problems = compare(spark, folder, name, queries.QUERIES[name], queries.ORACLES[name])
    assert rows > 0 and not problems, problems
