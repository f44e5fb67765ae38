"""Word texts: the same words, vocabulary and counts as an array of terms, without a row for every term of a document."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiflux.operators import topics, vectorize
from epiflux.plans import load_all

ODD = [
    None, "", "a", "cent", "cent\n", "recent centres <b>x</b> 1,234.5 http://a.b/c?d", "prepared preparedness prepd", "coronatesting tests",
    "<open 3<4> 5,,6", "année ßtraße ǅ ²³ x² Ⅷab ٣٤ 日本 語言 _a a_b", "http https:// hTTps://X.y Z.z", "tested,hospitals\tcases\ncases",
]


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(3)
    common, rare = [f"w{c}" for c in "abcdefgh"], [f"r{i}q" for i in range(400)]
    made = [" ".join(rng.choices(common, k=rng.randint(0, 40)) + rng.choices(rare, k=5)) for _ in range(150)]
    texts = spark.createDataFrame(list(enumerate(ODD + made)), "doc_id long, text string").repartition(3)
    words = texts.select("doc_id", vectorize.word_text(F.lower("text")).alias("words"))
    return words, vectorize.with_terms(texts, F.lower("text")).select("doc_id", "terms")


def test_words_are_the_tokens(both):
    words, terms = both
    want = {r.doc_id: r.terms for r in terms.collect()}
    for row in words.collect():
        found = None if row.words is None else row.words.split()
        assert want[row.doc_id] == (None if found is None else found + [f"{a} {b}" for a, b in zip(found, found[1:])])


@pytest.mark.parametrize("least, share, most", [(1, 1.0, 10_000), (2, 0.9, 30), (5, 0.5, 8), (1, 0.9, 400), (3, 0.2, 50), (500, 0.9, 5)])
def test_vocabulary_and_vectors_are_those_of_terms(both, least, share, most, monkeypatch):
    words, terms = both
    counts = vectorize.term_counts(terms, "doc_id", "terms")
    want = sorted(map(tuple, vectorize.vocabulary(counts, terms.agg(F.count(F.lit(1))), least, share, most).collect()))
    assert sorted(map(tuple, vectorize.ngram_vocabulary(words, "words", least, share, most).collect())) == want
    with monkeypatch.context() as few:
        few.setattr(vectorize, "MOST_WORDS", 0)  # counted as strings
        assert sorted(map(tuple, vectorize.ngram_vocabulary(words, "words", least, share, most).collect())) == want
    names = [row[0] for row in want]
    if names:
        plain = topics.document_vectors(terms, "doc_id", "terms", names, counts).select("doc_id", "at", "n")
        assert sorted(map(tuple, vectorize.ngram_vectors(words, "words", names).collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("least, part_least, share, most", [(5, 2, 0.9, 10_000), (2, 5, 0.9, 30), (1, 0, 0.5, 8), (500, 1, 0.9, 400)])
def test_vocabulary_of_a_part_comes_from_the_same_count(both, least, part_least, share, most, monkeypatch):
    words, _ = both
    part = F.expr("nullif(doc_id, 30) % 3 = 0")
    want = [sorted(map(tuple, vectorize.ngram_vocabulary(frame, "words", n, share, most).collect()))
            for frame, n in ((words, least), (words.filter(part), part_least))]
    for name, value in {"MOST_WORDS": vectorize.MOST_WORDS, "_TEXTS": 2, "_HELD_TEXTS": 3}.items():
        monkeypatch.setattr(vectorize, name, value)
        found = vectorize.ngram_vocabularies(words, "words", part, least, part_least, share, most)
        assert [sorted(map(tuple, one.collect())) for one in found] == want
    monkeypatch.setattr(vectorize, "MOST_WORDS", 0)  # counted as strings
    found = vectorize.ngram_vocabularies(words, "words", part, least, part_least, share, most)
    assert [sorted(map(tuple, one.collect())) for one in found] == want


def test_remapped_topics_count_words_once_and_score_one_day(spark, monkeypatch):
    written, scored = [], []
    write, vectors = vectorize.stored, topics.document_vectors
    monkeypatch.setattr(vectorize, "stored", lambda frame, label: written.append(label) or write(frame, label))
    monkeypatch.setattr(topics, "document_vectors", lambda docs, *rest: scored.append(docs) or vectors(docs, *rest))
    load_all()[0]["topic_remap"](spark, "/root/testdata/sf0.001")
    assert written.count("word-statistics") == 1
    assert [str(row.day) for frame in scored for row in frame.select("day").distinct().collect()] == ["2024-01-05"]


def test_pairs_of_rare_words_are_not_formed(both):
    words, _ = both
    pairs = vectorize.pair_statistics(words, "words", ["wa", "wb"]).collect()
    assert {row.pair for row in pairs} <= set(range(4)) and len(pairs) == 4


@pytest.mark.parametrize("cut", [1, 40, 700])
def test_words_do_not_depend_on_how_texts_are_cut(spark, monkeypatch, cut):
    texts = spark.createDataFrame(list(enumerate([*ODD, "", None, *ODD[::-1]])), "doc_id long, text string").coalesce(1)
    want = vectorize.with_terms(texts, F.lower("text")).select("doc_id", "terms").collect()
    monkeypatch.setattr(vectorize, "_CUT", cut)
    found = {r.doc_id: r.words for r in texts.select("doc_id", vectorize.word_text(F.lower("text")).alias("words")).collect()}
    for doc_id, terms in want:
        assert found[doc_id] == (None if terms is None else " ".join(term for term in terms if " " not in term))


@pytest.mark.parametrize("held", [1, 3, 50])
def test_pairs_do_not_depend_on_how_many_texts_are_held(both, monkeypatch, held):
    words, _ = both
    names = [f"w{c}" for c in "abcdefgh"]
    want = sorted(map(tuple, vectorize.pair_statistics(words, "words", names).collect()))
    monkeypatch.setattr(vectorize, "_TEXTS", 2)
    monkeypatch.setattr(vectorize, "_HELD_TEXTS", held)
    assert len(want) == 49 and sorted(map(tuple, vectorize.pair_statistics(words, "words", names).collect())) == want


def test_models_of_words_are_those_of_terms(both):
    words, terms = both
    one, other = (topics.fit_topics(frame, "doc_id", name, k=2, passes=1, min_df=5)
                  for frame, name in ((words, "words"), (terms, "terms")))
    assert one.terms == other.terms and np.allclose(one.counts, other.counts)


def test_words_become_shares_in_one_python_worker(both):
    words, _ = both
    names = ["wa", "wb", "wa wb", "wc"]
    model = topics.TopicModel(np.array([[9.0, 1, 1, 2], [1, 8, 3, 1]]), names, 0.1)
    found = topics.score_documents(model, words, "doc_id", "words")
    model.vectors = topics.document_vectors(words, "doc_id", "words", names)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, topics.doc_topics(model, ["doc_id"]).collect()))
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # that of the words


@pytest.mark.parametrize("held", [1, 500])
def test_word_counts_do_not_depend_on_how_many_are_held(both, monkeypatch, held):
    words, _ = both
    part = F.expr("doc_id % 3 = 0")
    want = sorted(map(tuple, vectorize.word_statistics(words, "words", part).collect()))
    monkeypatch.setattr(vectorize, "_TEXTS", 2)
    monkeypatch.setattr(vectorize, "_HELD_COUNTS", held)
    assert len(want) > 20 and sorted(map(tuple, vectorize.word_statistics(words, "words", part).collect())) == want
