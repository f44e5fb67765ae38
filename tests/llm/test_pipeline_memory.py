"""What the pipeline's stages hold at once."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from epiflux.llm import byte_bpe, toxicity


def _rows():
    draw = np.random.default_rng(3)
    terms = [np.unique(draw.zipf(1.3, 60) % 2_000).astype(np.int32) for _ in range(600)]
    return terms, np.array([float(3 in found and 5 in found or draw.random() < 0.1) for found in terms])


def test_pairs_are_counted_over_a_bounded_part_of_the_cells(monkeypatch):
    terms, labels = _rows()
    whole = toxicity._screen(terms, labels)
    assert len(whole)
    for cells in (1, 100, 1_000):
        monkeypatch.setattr(toxicity, "_CELLS", cells)
        assert np.array_equal(toxicity._screen(terms, labels), whole)


def test_memory_of_pairs_without_all_cells_twice(monkeypatch):
    monkeypatch.setattr(toxicity, "_CELLS", 10_000, raising=False)
    monkeypatch.setattr(toxicity, "BUCKETS", 2_000)
    # each bucket in every second row, so that the cells are most of what is held
    terms = [np.arange(row % 2, 2_000, 2, np.int32) for row in range(800)]
    labels = np.array([float(row % 3 == 0) for row in range(800)])
    buckets, counts = np.arange(2_000), [np.zeros(2_000, int) for _ in range(2)]
    for found, toxic in zip(terms, labels):
        counts[int(toxic)][found] += 1
    cells = sum(map(len, terms))
    tracemalloc.start()
    toxicity._paired(terms, labels, buckets, counts[1], counts[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * cells  # 4 bytes for the sorted rows; the cells of all buckets took 8 more


def test_ids_and_decoded_text_come_from_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "Zwei Wörter, 12 %%%"), (2, None), (3, ""), (4, "日本 a🙂")], "doc_id long, text string")
    apart = byte_bpe.decode(byte_bpe.encode(docs))
    assert sorted(byte_bpe.encode_and_decode(docs).collect()) == sorted(apart.collect())
    want = apart.select("doc_id", F.size("ids").cast("long"), "ids", F.sha2("decoded", 256))
    got = corpus_pipeline.tokens(spark, docs, "")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
