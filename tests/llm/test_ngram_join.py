"""The Jaccard join against brute force, with and without frequent shingles and large blocks."""

import random

import pytest

from epiflux.llm import ngram_join


def brute(rows):
    sets = []
    for key, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        grams = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        sets.append((key, grams))
    parent = {key: key for key, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return sorted((key, len(grams), top(key)) for key, grams in sets)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(12):
        words = [word() for _ in range(rng.randint(1, 120))]
        if base % 3 == 0:
            words = passage + words[: rng.randint(0, 20)]
        for _ in range(rng.randint(1, 14)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, " \n\t", "One two", "one TWO", "one two three", "Äb äb"]
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("seed,share,block", [(1, 0.002, 2048), (2, 0.05, 2048), (3, 0.05, 4), (4, 1.0, 6)])
def test_same_as_brute_force(spark, monkeypatch, seed, share, block):
    """Low bounds make shingles frequent and blocks large; the result stays."""
    monkeypatch.setattr(ngram_join, "HOT_SHARE", share)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    if share < 1:
        monkeypatch.setattr(ngram_join, "HOT_DOCS", 4)
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_join(frame).collect()))
    assert got == brute(rows)


def test_a_task_that_deals_out_keys_has_one_python_worker(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0.05)
    monkeypatch.setattr(ngram_join, "HOT_DOCS", 4)
    plans, write = {}, ngram_join.stored

    def noted(frame, label):
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return write(frame, label)

    monkeypatch.setattr(ngram_join, "stored", noted)
    rows = corpus(2)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_join(frame).collect())) == brute(rows)
    assert "jaccard-reread" in plans  # some shingles are frequent
    assert "ArrowEvalPython" not in plans["jaccard-members"]


def test_empty_and_nulls(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_join(frame).collect() == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "x"), (None, None), (7, "q"), (7, "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, ngram_join.jaccard_join(frame).collect())))
    assert got == sorted(map(str, [(None, 2, 3), (3, 2, 3), (None, 1, None), (None, 0, None), (7, 1, 7), (7, 1, 7)]))


def test_tree_finds_what_pairs_find():
    rng = random.Random(5)
    rows = [text for _, text in corpus(6) if text and text.strip()]
    sets = [ngram_join.shingle_set(text) for text in rows]
    members = [(i, len(s), ngram_join.bitmap(s), rng.randrange(2 * len(sets))) for i, s in enumerate(sets)]
    found = set(ngram_join.search(ngram_join.build_tree(members)))
    for i, x in enumerate(sets):
        for j in range(i):
            if ngram_join.linked(x, sets[j]) and members[i][3] != members[j][3]:
                assert (j, i) in found
