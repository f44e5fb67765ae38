"""The corpus pipeline: documents in, token ids of what is kept out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiflux.llm import byte_bpe, decontamination, ngram_join, secret_scan, toxicity
from epiflux.llm.common import by_ids, held_out, in_small_batches
from epiflux.session import stored
from epiflux.sources.tables import table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least one half go.  The model learns as in op1, from this stage's input."""
    in_small_batches(spark)
    seen = ~held_out("doc_id", 5, 0)
    model = toxicity.fit(docs.filter(seen), table(spark, sf_dir, "labels").filter(seen))
    scored = toxicity.score(docs, model, name="_toxic_score")
    return scored.filter(F.col("_toxic_score") < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays.

    Rows that repeat an id which stays are one document and one of them stays; rows
    without an id stay.
    """
    in_small_batches(spark)
    joined = stored(ngram_join.jaccard_join(docs), "near-duplicates")
    copies = stored(joined.filter("component_id <> doc_id").select("doc_id").distinct(), "copies")
    repeated = stored(joined.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    kept = by_ids(docs, "doc_id", copies, "left_anti").select(*docs.columns)
    once = by_ids(kept, "doc_id", repeated, "left_anti").select(*docs.columns)
    again = by_ids(kept, "doc_id", repeated, "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return once.unionByName(again)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    in_small_batches(spark)
    hits = decontamination.find_hits(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")),
                                     table(spark, sf_dir, "benchmark"))
    return hits.filter(F.col("n_hit") == 0).select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become the name of their kind; the documents stay."""
    in_small_batches(spark)
    row = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))
    clean = secret_scan.redact(secret_scan.scan(row))
    columns = [F.col(f"doc.`{name}`") if name != "text" else F.col("text") for name in docs.columns]
    return clean.select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every text: its ids, and the digest of what they decode to."""
    in_small_batches(spark)
    coded = byte_bpe.encode_and_decode(docs.select("doc_id", "text"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", contaminated),
    ("secret_scan", secrets),
    ("byte_bpe", tokens),
]

#: The model of the first stage has no SQL; the tests follow it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
