"""Inputs several queries share, derived from the driver tables, as frames and as SQL.

The tables hold clean prose and numbers.  Variants (spellings, markup, missing
values) are added by rule from each row's key, so every row takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiflux.functions.fixed_values import STOP_WORDS
from epiflux.operators.partitioning import spread
from epiflux.plans.registry import sql_list, sql_text
from epiflux.sources.tables import table

# Cumulative counts per "state-county" key: event types stand in for counties.
CASES_SQL = """
daily AS (
  SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL),
cases AS (
  SELECT 'S-' || event_type AS county, date,
         CAST(sum(n) OVER (PARTITION BY event_type ORDER BY date) AS BIGINT) AS confirmed
  FROM daily)
"""


def cases(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "event_type", "ts")
    daily = events.groupBy("event_type", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    running = F.expr("sum(n) OVER (PARTITION BY event_type ORDER BY date)")
    return daily.select(
        F.concat(F.lit("S-"), "event_type").alias("county"), "date", running.alias("confirmed")
    )


# Messages: document texts with links, tags, emoticons and hashtags appended by key.
DECORATION = """
CASE doc_id % 6
  WHEN 0 THEN ' see https://t.co/ab?x=' || doc_id || ' now 1,234.5 <b>z</b>'
  WHEN 1 THEN ' Hi #Covid x#no #' || source || ' #année :)'
  WHEN 2 THEN ' prepared preparedness centres testing cases ;P =D 10:30'
  WHEN 3 THEN ' corona virus prep #Update #stayhome http://a.b/c :-('
  WHEN 4 THEN ' covid ready hospitals realdonaldtrump #ready'
  ELSE '' END
"""
ENTITY_TEXTS = [
    "{u'hashtags': [{u'text': u'covid', u'indices': [1, 2]}, {u'text': u'%s', u'indices': [9, 12]}], u'urls': []}",
    "{u'hashtags': [], u'urls': []}",
    '{"x":1}',
    "{u'hashtags': [{u'text': bad, u'urls': []}",
    "{u'hashtags': [{u'text': u'menu'}, {u'text': u'menu'}], u'urls': []}",
]
ENTITIES_SQL = "CASE doc_id % 5 " + " ".join(
    f"WHEN {i} THEN replace({sql_text(text)}, '%s', source)" for i, text in enumerate(ENTITY_TEXTS)
) + " END"
MESSAGES_SQL = f"""
messages AS (
  SELECT doc_id AS id, text || {DECORATION} AS text,
         CASE WHEN doc_id % 4 = 0 THEN ' quoted ' || lang WHEN doc_id % 4 = 1 THEN '' END AS quoted_text,
         {ENTITIES_SQL} AS entities, lang, source,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 437) % 518400) AS created_ts,
         DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER) AS created_dt
  FROM documents)
"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents", "doc_id", "text", "lang", "source"), "doc_id")
    key = F.col("doc_id")
    return documents.select(
        key.alias("id"),
        F.concat("text", F.expr(DECORATION)).alias("text"),
        F.when(key % 4 == 0, F.concat(F.lit(" quoted "), "lang")).when(key % 4 == 1, "").alias("quoted_text"),
        F.replace(
            F.element_at(F.array(*[F.lit(text) for text in ENTITY_TEXTS]), (key % 5 + 1).cast("int")),
            F.lit("%s"), F.col("source"),
        ).alias("entities"),
        "lang", "source",
        F.timestamp_seconds(F.lit(1704067200) + (key * 437) % 518400).alias("created_ts"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 5).cast("int")).alias("created_dt"),
    )


TOKEN_SQL = r"[\p{L}\p{N}_]{2,}"


def tokens_sql(text: str) -> str:
    """SQL list of the words of a text that are no stop words."""
    return (
        f"list_filter(regexp_extract_all({text}, '{TOKEN_SQL}'), "
        f"lambda w: w NOT IN ({sql_list(STOP_WORDS)}))"
    )


def joined(values: str | Column) -> Column:
    """Array as text, for results that are compared by value."""
    return F.array_join(values, "|")


_BLOCK_SQL = """
list_max(list_transform(range(1, length(l) + 1), lambda i: {
  'k': len(list_filter(range(1, length(l) - i + 2), lambda k: contains(r, substr(l, i, k)))), 'i': -i}))
"""

#: ``ratios (p, c, score)`` of the texts in ``compared (p, c)`` by matching blocks; needs WITH RECURSIVE.
RATIOS_SQL = f"""
pieces AS (
  SELECT p, c, l, r, {_BLOCK_SQL} AS block FROM (SELECT p, c, p AS l, c AS r FROM compared)
  UNION ALL
  SELECT p, c, l, r, {_BLOCK_SQL} AS block FROM (
    SELECT p, c, unnest([substr(l, 1, CAST(-block.i - 1 AS BIGINT)), substr(l, CAST(block.k - block.i AS BIGINT))]) AS l,
           unnest([substr(r, 1, strpos(r, substr(l, -block.i, block.k)) - 1),
                   substr(r, strpos(r, substr(l, -block.i, block.k)) + block.k)]) AS r
    FROM pieces WHERE block.k > 0)
  WHERE l <> '' AND r <> ''),
ratios AS (
  SELECT p, c, CAST(round_even(100 * (2.0::DOUBLE * sum(block.k) / (length(p) + length(c))), 0) AS INTEGER) AS score
  FROM pieces GROUP BY p, c)
"""
