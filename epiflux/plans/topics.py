"""Topic models over the messages; a message's day comes from its key.

Fitted models are random in their start and have no SQL.  What is read from a model is
compared with SQL on a bound one, whose pseudo-counts follow from a term's place in the
vocabulary; documents are then inferred by two iterations in either engine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from epiflux.operators import drifting, topics, vectorize
from epiflux.operators.partitioning import spread
from epiflux.operators.topics import TopicModel
from epiflux.plans.bindings import MESSAGES_SQL, messages
from epiflux.plans.registry import query
from epiflux.plans.text import TERMS_SQL
from epiflux.session import scratch, stored
from epiflux.sources.tables import fixed_table, table

_K = 3
_ALPHA = 0.01
_DAYS = [f"2024-01-{day:02d}" for day in range(1, 6)]


@query(
    "docs_per_day",
    f"WITH {MESSAGES_SQL} SELECT created_dt AS day, count(*) AS docs FROM messages GROUP BY 1",
)
def docs_per_day(spark, folder):
    rows = messages(spark, folder).groupBy(F.col("created_dt").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("docs"))


def _docs(spark, folder):
    """Documents with their day and their cleaned words, written once."""
    docs = spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))
    words = vectorize.word_text(F.lower("text"))
    return stored(docs.select("doc_id", day.alias("day"), words.alias("words")), "topic-docs")


def _counted(spark, folder):
    """Documents and the vocabulary in column order."""
    docs = _docs(spark, folder)
    return docs, topics.frequent_terms(vectorize.ngram_vocabulary(docs, "words"))


def _fitted(spark, folder):
    return topics.fit_topics(_docs(spark, folder), "doc_id", "words", k=_K, alpha=_ALPHA)


# ---------------------------------------------------------------- fitted models


@query("lda_topics")
def lda_topics(spark, folder):
    return topics.topic_terms(_fitted(spark, folder))


def _drifting(spark, folder):
    fitted = _fitted(spark, folder)
    return fitted, drifting.fit_drifting_topics(fitted, "day", chain_variance=0.005, sweeps=5, tolerance=1e-3)


@query("dynamic_topics")
def dynamic_topics(spark, folder):
    return _drifting(spark, folder)[1].weights


@query("dynamic_topic_share")
def dynamic_topic_share(spark, folder):
    return topics.daily_shares(_drifting(spark, folder)[1].shares, "day")


@query("topic_coherence")
def topic_coherence(spark, folder):
    """Coherence of the fitted topics: of the static ones, of each day's, and the mean over days."""
    fitted, model = _drifting(spark, folder)
    still = topics.topic_terms(fitted, 20).select(F.lit(None).cast("date").alias("day"), "topic", "rank", "term")
    moving = drifting.top_terms_by_day(model.weights, 20).select("day", "topic", "rank", "term")
    scores = stored(
        topics.umass_coherence(fitted.vectors, fitted.terms, still.unionByName(moving), ["day", "topic"]), "coherence")
    mean = scores.filter("day IS NOT NULL").groupBy("day").agg(F.avg("coherence").alias("coherence")).agg(
        F.avg("coherence").alias("coherence"))
    return scores.withColumn("of", F.when(F.col("day").isNull(), "static").otherwise("day")).unionByName(
        mean.withColumn("of", F.lit("mean")), allowMissingColumns=True)


# ---------------------------------------------------------------- bound models


def _bound_counts(terms: int) -> np.ndarray:
    at, k = np.arange(terms), np.arange(_K)[:, None]
    return 1.0 + 10 * (at % _K == k) + (at * (k + 2)) % 5


def _digamma_sql(x: str) -> str:
    far = f"({x} + 6)"
    square = f"(1 / ({far} * {far}))"
    steps = " + ".join(f"1 / ({x} + {step})" for step in range(6))
    return f"(ln({far}) - 0.5 / {far} - {square} * (1.0 / 12 - {square} * (1.0 / 120 - {square} / 252)) - ({steps}))"


def _turn_sql(old: str, new: str) -> str:
    """One iteration over the documents: pseudo-counts ``new`` from ``old``."""
    return f"""
theta_{old} AS (
  SELECT doc_id, k, exp({_digamma_sql('g')} - {_digamma_sql('(sum(g) OVER (PARTITION BY doc_id))')}) AS theta FROM {old}),
norm_{old} AS (
  SELECT doc_id, pos, n, sum(theta * b) AS s FROM cells JOIN beta USING (pos) JOIN theta_{old} USING (doc_id, k) GROUP BY ALL),
{new} AS (
  SELECT doc_id, k, {_ALPHA} + theta * coalesce(sum(n * b / s), 0) AS g
  FROM theta_{old} LEFT JOIN norm_{old} USING (doc_id) LEFT JOIN beta USING (pos, k) GROUP BY doc_id, k, theta)"""


BOUND_SQL = f"""
{TERMS_SQL},
listed AS (SELECT term, row_number() OVER (ORDER BY total DESC, term) - 1 AS pos FROM vocab),
lam AS (
  SELECT term, pos, k, 1.0::DOUBLE + 10 * CAST(pos % {_K} = k AS INT) + (pos * (k + 2)) % 5 AS l FROM listed, range({_K}) AS t(k)),
beta AS (
  SELECT pos, k, exp({_digamma_sql('l')} - {_digamma_sql('(sum(l) OVER (PARTITION BY k))')}) AS b FROM lam),
cells AS (SELECT doc_id, pos, n FROM counts JOIN listed USING (term))
"""
SHARES_SQL = f"""
{BOUND_SQL},
g0 AS (
  SELECT doc_id, k, {_ALPHA} + coalesce(total, 0) / {_K}::DOUBLE AS g
  FROM documents CROSS JOIN range({_K}) AS t(k)
  LEFT JOIN (SELECT doc_id, sum(n) AS total FROM cells GROUP BY doc_id) USING (doc_id)),
{_turn_sql('g0', 'g1')}, {_turn_sql('g1', 'g2')},
shares AS (
  SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER) AS day, CAST(k AS INTEGER) AS topic,
         round(g / sum(g) OVER (PARTITION BY doc_id), 6) AS share FROM g2)
"""


def _scored(spark, folder):
    """Shares of all documents by a model that was written and read again."""
    docs, names = _counted(spark, folder)
    path = scratch(spark, "topic-model")
    topics.save_topics(TopicModel(_bound_counts(len(names)), names, _ALPHA), spark, path)
    found = topics.score_documents(topics.load_topics(spark, path), docs, "doc_id", "words", iterations=2, tolerance=0.0)
    return found.withColumn("shares", F.transform("shares", lambda share: F.round(share, 6)))


@query("topic_scores", f"WITH {SHARES_SQL} SELECT * FROM shares")
def topic_scores(spark, folder):
    return topics.long_shares(_scored(spark, folder))


@query(
    "lda_online_step",
    f"""
    WITH {SHARES_SQL},
    batch AS (
      SELECT doc_id FROM documents WHERE CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 4 = 1),
    theta AS (
      SELECT doc_id, k, exp({_digamma_sql('g')} - {_digamma_sql('(sum(g) OVER (PARTITION BY doc_id))')}) AS theta
      FROM g2 WHERE doc_id IN (SELECT doc_id FROM batch)),
    norm AS (SELECT doc_id, pos, n, sum(theta * b) AS s FROM cells JOIN theta USING (doc_id) JOIN beta USING (pos, k) GROUP BY ALL),
    expected AS (
      SELECT pos, k, sum(theta * b * n / s) AS e FROM norm JOIN theta USING (doc_id) JOIN beta USING (pos, k) GROUP BY pos, k),
    step AS (
      SELECT term, k, (1 - 2 ** -0.5) * l + 2 ** -0.5 * (1 / {_K}::DOUBLE
             + coalesce(e, 0) * (SELECT count(*) FROM documents) / (SELECT count(*) FROM batch)) AS l
      FROM lam LEFT JOIN expected USING (pos, k))
    SELECT CAST(k AS INTEGER) AS topic, term, round(l, 6) AS count FROM step
    """,
)
def lda_online_step(spark, folder):
    """The second step of a fit, from bound pseudo-counts."""
    docs, names = _counted(spark, folder)
    vectors = stored(topics.document_vectors(docs, "doc_id", "words", names), "topic-vectors")
    batch = vectors.filter(topics.batch_of("doc_id", 4) == 1)
    lam = topics.online_step(
        _bound_counts(len(names)), batch, batch.count() / vectors.count(), 1, _ALPHA, 1 / _K, iterations=2)
    rows = [(k, term, float(lam[k, at])) for k in range(_K) for at, term in enumerate(names)]
    return fixed_table(spark, rows, "topic int, term string, count double").withColumn("count", F.round("count", 6))


_WORDS = ", ".join(f'max(CASE WHEN k = {k} THEN term END) AS "{k}"' for k in range(_K))


@query(
    "topic_top_words",
    f"""
    WITH {BOUND_SQL},
    ranked AS (
      SELECT k, term, row_number() OVER (PARTITION BY k ORDER BY l DESC, pos) - 1 AS rank FROM lam)
    SELECT CAST(rank AS INTEGER) AS rank, {_WORDS} FROM ranked WHERE rank < 20 GROUP BY rank
    """,
)
def topic_top_words(spark, folder):
    _, names = _counted(spark, folder)
    top = topics.topic_terms(TopicModel(_bound_counts(len(names)), names, _ALPHA), 20)
    return top.groupBy("rank").pivot("topic", list(range(_K))).agg(F.max("term"))


@query(
    "topic_top_docs",
    f"""
    WITH {SHARES_SQL}
    SELECT doc_id, day, topic, share, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY share DESC, doc_id) AS rank FROM shares) WHERE rank <= 20
    """,
)
def topic_top_docs(spark, folder):
    return topics.top_docs(_scored(spark, folder), "doc_id", 20)


@query(
    "topic_share_daily",
    f"WITH {SHARES_SQL} SELECT day, topic, round(avg(share), 9) AS share FROM shares GROUP BY day, topic",
)
def topic_share_daily(spark, folder):
    return topics.daily_shares(_scored(spark, folder), "day").select("day", "topic", F.round("share", 9).alias("share"))


@query(
    "topic_volume_daily",
    f"""
    WITH {SHARES_SQL}
    SELECT day, topic, count(*) AS docs, round(avg(share) * count(*), 6) AS volume FROM shares GROUP BY day, topic
    """,
)
def topic_volume_daily(spark, folder):
    daily = topics.daily_shares(_scored(spark, folder), "day")
    return daily.select("day", "topic", "docs", F.round("volume", 6).alias("volume"))


@query("topic_min_prob", f"WITH {SHARES_SQL} SELECT * FROM shares WHERE share >= 0.05")
def topic_min_prob(spark, folder):
    return topics.likely_topics(_scored(spark, folder))


DAY_WEIGHTS_SQL = f"""
{TERMS_SQL},
listed AS (SELECT term, row_number() OVER (ORDER BY total DESC, term) - 1 AS pos FROM vocab),
weights AS (
  SELECT DATE '2024-01-01' + CAST(d AS INTEGER) AS day, CAST(k AS INTEGER) AS topic, term,
         CAST(1 + (pos * (k + 2) + d * (pos % 7)) % 13 AS DOUBLE) AS weight
  FROM listed, range({_K}) AS t(k), range(5) AS u(d))
"""


def _day_weights(spark, names):
    """Weights bound to a term's place, the topic and the day."""
    listed = fixed_table(spark, enumerate(names), "at int, term string")
    cells = listed.select("at", "term", F.explode(F.sequence(F.lit(0), F.lit(_K - 1))).alias("topic")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("d"))
    at, topic, d = F.col("at"), F.col("topic"), F.col("d")
    return cells.select(
        F.date_add(F.lit("2024-01-01").cast("date"), d).alias("day"), "topic", "term",
        (1 + (at * (topic + 2) + d * (at % 7)) % 13).cast("double").alias("weight"))


@query(
    "topic_evolution",
    f"""
    WITH {DAY_WEIGHTS_SQL},
    ranked AS (
      SELECT day, term, row_number() OVER (PARTITION BY day ORDER BY weight DESC, term) - 1 AS rank
      FROM weights WHERE topic = 1)
    SELECT CAST(rank AS INTEGER) AS rank, {", ".join(f"max(CASE WHEN day = DATE '{day}' THEN term END) AS " + '"' + day + '"' for day in _DAYS)}
    FROM ranked WHERE rank < 20 GROUP BY rank
    """,
)
def topic_evolution(spark, folder):
    _, names = _counted(spark, folder)
    return drifting.topic_evolution(_day_weights(spark, names), 1, _DAYS)


@query(
    "umass_coherence",
    f"""
    WITH {DAY_WEIGHTS_SQL},
    top AS (
      SELECT day, topic, term, row_number() OVER (PARTITION BY day, topic ORDER BY weight DESC, term) - 1 AS rank FROM weights),
    lists AS (SELECT * FROM top WHERE rank < 20),
    hits AS (SELECT doc_id, term FROM counts WHERE term IN (SELECT term FROM lists)),
    alone AS (SELECT term, count(*) AS docs FROM hits GROUP BY term),
    together AS (
      SELECT l.term AS later, e.term AS earlier, count(*) AS docs
      FROM hits l JOIN hits e ON l.doc_id = e.doc_id AND l.term <> e.term GROUP BY ALL),
    pairs AS (
      SELECT l.day, l.topic, l.term AS later, e.term AS earlier
      FROM lists l JOIN lists e ON l.day = e.day AND l.topic = e.topic AND e.rank < l.rank),
    n AS (SELECT count(*) AS n FROM documents),
    scores AS (
      SELECT pairs.day, pairs.topic, avg(ln((coalesce(together.docs, 0) / n + 1e-12) / (alone.docs / n))) AS coherence
      FROM pairs LEFT JOIN together USING (later, earlier) JOIN alone ON alone.term = pairs.earlier, n GROUP BY ALL)
    SELECT day, topic, round(coherence, 6) AS coherence FROM scores
    UNION ALL SELECT NULL, NULL, round(avg(mean), 6) FROM (SELECT avg(coherence) AS mean FROM scores GROUP BY day)
    """,
)
def umass_coherence(spark, folder):
    """Coherence of each day's topics, over all documents, and its mean over the days."""
    docs, names = _counted(spark, folder)
    vectors = stored(topics.document_vectors(docs, "doc_id", "words", names), "topic-vectors")
    lists = drifting.top_terms_by_day(_day_weights(spark, names), 20)
    scores = stored(topics.umass_coherence(vectors, names, lists, ["day", "topic"]), "coherence")
    mean = scores.groupBy("day").agg(F.avg("coherence").alias("coherence")).agg(F.avg("coherence").alias("coherence"))
    return scores.unionByName(mean, allowMissingColumns=True).withColumn("coherence", F.round("coherence", 6))


@query(
    "topic_remap",
    f"""
    WITH {SHARES_SQL},
    later AS (SELECT doc_id FROM documents WHERE doc_id % 5 >= 2),
    new_vocab AS (
      SELECT term FROM counts WHERE doc_id IN (SELECT doc_id FROM later) GROUP BY term
      HAVING count(*) >= 5 AND count(*) <= 0.9 * (SELECT count(*) FROM later) ORDER BY sum(n) DESC, term LIMIT 10000),
    names AS (SELECT unnest(['0', '1', '2', '2024-01-06:0']) AS topic_name),
    weights AS (SELECT term, CAST(k AS VARCHAR) AS topic_name, l / sum(l) OVER (PARTITION BY k) AS weight FROM lam)
    SELECT term, topic_name, round(coalesce(weight, pow(1 - 1 / 900.0::DOUBLE + (list_sum(list_transform(range(12), lambda i:
             CAST('0x' || left(md5(term || ':' || topic_name || ':' || i), 8) AS BIGINT) / 4294967296.0::DOUBLE)) - 6)
             * sqrt(1 / 900.0::DOUBLE), 3)), 9) AS weight
    FROM new_vocab CROSS JOIN names LEFT JOIN weights USING (term, topic_name)
    """,
)
def topic_remap(spark, folder):
    docs = _docs(spark, folder)
    listed, vocab = vectorize.ngram_vocabularies(docs, "words", F.expr("day >= DATE '2024-01-03'"), part_min_df=5)
    names = topics.frequent_terms(listed)
    model = TopicModel(_bound_counts(len(names)), names, _ALPHA)
    # a document's shares do not depend on others, so those of other days are not needed
    model.vectors = topics.document_vectors(docs.filter("day = DATE '2024-01-05'"), "doc_id", "words", names)
    shares = topics.doc_topics(model, ["doc_id", "day"], iterations=2, tolerance=0.0)
    last = topics.daily_shares(shares, "day").select("topic", "share")
    weights = topics.topic_terms(model).select("topic", "term", "weight")
    carried = topics.carry_topics(weights, last, vocab, 4, "2024-01-06")
    return carried.withColumn("weight", F.round("weight", 9))
