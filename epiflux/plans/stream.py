"""Streams over the driver files, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiflux.functions.fixed_values import TRACKED_DISEASE, TRACKED_PREPAREDNESS
from epiflux.plans.bindings import DECORATION, joined
from epiflux.plans.registry import query, sql_text
from epiflux.session import scratch
from epiflux.sources import readers
from epiflux.sources.schemas import TWEET_STREAM
from epiflux.sources.tables import table
from epiflux.streaming import live
from epiflux.streaming.keyed import KeyedStore, put_by_key

_DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _documents(spark, folder):
    return live.table_stream(spark, folder, "documents", _DOCUMENTS).withColumn(
        "text", F.concat("text", F.expr(DECORATION))
    )


def _finish(running):
    running.awaitTermination()
    return running


def _tracked_sql(phrases):
    found = " OR ".join(
        "(" + " AND ".join(f"contains(lower(text), {sql_text(w)})" for w in phrase.split()) + ")" for phrase in phrases
    )
    return f"""
    SELECT doc_id, source, md5(text) AS text_md5 FROM (SELECT doc_id, lang, source, text || {DECORATION} AS text FROM documents)
    WHERE lang = 'en' AND ({found})
    """


def _tracked(spark, folder, phrases):
    hits = live.keyword_filter(_documents(spark, folder), "text", "lang", phrases)
    out = scratch(spark, "tracked")
    _finish(live.append_table(
        hits.select("doc_id", "source", F.md5("text").alias("text_md5")), out, scratch(spark, "mark"), availableNow=True
    ))
    return spark.read.schema("doc_id bigint, source string, text_md5 string").parquet(out)


@query("stream_keyword_filter", _tracked_sql(TRACKED_PREPAREDNESS))
def stream_keyword_filter(spark, folder):
    return _tracked(spark, folder, TRACKED_PREPAREDNESS)


@query("stream_disease_filter", _tracked_sql(TRACKED_DISEASE))
def stream_disease_filter(spark, folder):
    """The second collection's phrases."""
    return _tracked(spark, folder, TRACKED_DISEASE)


def _status_json():
    """A status document of every row, with optional parts present by key."""
    key = F.col("doc_id")
    return F.to_json(
        F.struct(
            key.alias("id"),
            F.concat(F.lit("Mon Jan 01 00:"), F.lpad((key % 60).cast("string"), 2, "0")).alias("created_at"),
            # short only where the whole text is carried beside it
            F.when(key % 3 == 0, F.left("text", F.lit(140))).otherwise(F.col("text")).alias("text"),
            F.col("lang"),
            F.when(key % 3 == 0, F.struct(F.col("text").alias("full_text"))).alias("extended_tweet"),
            F.when(key % 4 == 0, F.struct((key + 1).alias("id"))).alias("retweeted_status"),
            (key % 9).alias("retweet_count"),
            F.when(
                key % 5 == 0,
                F.struct(
                    F.col("source").alias("text"),
                    F.when(key % 10 == 0, F.struct(F.concat("source", F.lit("\tlong\nquote")).alias("full_text"))).alias("extended_tweet"),
                ),
            ).alias("quoted_status"),
            F.struct(
                (key % 100).alias("id"), F.concat(F.lit("name "), key % 100).alias("name"),
                F.concat(F.lit("user"), key % 100).alias("screen_name"), F.col("source").alias("location"),
                (key % 2 == 0).alias("verified"), F.lit(-28800).alias("utc_offset"), F.lit("Pacific").alias("time_zone"),
            ).alias("user"),
            F.when(key % 3 == 1, F.struct(F.lit("US").alias("country_code")))
            .when(key % 3 == 2, F.struct(F.lit("GB").alias("country_code"))).alias("place"),
            F.struct(
                F.array(F.struct(F.col("lang").alias("text")), F.struct(F.lit("").alias("text"))).alias("hashtags"),
                F.array(F.struct(F.concat(F.lit("user"), key % 7).alias("screen_name"))).alias("user_mentions"),
                F.array().cast("array<struct<url:string>>").alias("urls"),
            ).alias("entities"),
        )
    )


_STATUS_SQL = f"""
statuses AS (
  SELECT *, text AS shown,
         CASE WHEN doc_id % 10 = 0 THEN source || chr(9) || 'long' || chr(10) || 'quote' WHEN doc_id % 5 = 0 THEN source END AS quoted,
         CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS retweet,
         'Mon Jan 01 00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') AS created
  FROM (SELECT doc_id, lang, source, text || {DECORATION} AS text FROM documents))
"""


@query(
    "tweet_projection",
    f"""
    WITH {_STATUS_SQL}
    SELECT doc_id AS id, created AS created_at_utc, md5(shown) AS text_md5, retweet, doc_id % 9 AS retweet_count,
           doc_id % 100 AS user_id, 'user' || doc_id % 100 AS screen_name, -28800 AS utc_offset, 'Pacific' AS time_zone,
           CASE doc_id % 3 WHEN 1 THEN 'US' WHEN 2 THEN 'GB' END AS place, CAST(NULL AS VARCHAR) AS coordinates,
           lang AS hashtags, 'user' || doc_id % 7 AS user_mentions, '' AS urls, quoted AS quoted_text FROM statuses
    """,
)
def tweet_projection(spark, folder):
    documents = table(spark, folder, "documents").withColumn("text", F.concat("text", F.expr(DECORATION)))
    statuses = live.parse_status(documents.select(_status_json().alias("value")))
    rows = live.document_columns(statuses)
    return rows.withColumns({c: joined(c) for c in ("hashtags", "user_mentions", "urls")}).withColumn(
        "text_md5", F.md5("text")
    ).drop("text")


@query(
    "stream_append",
    rf"""
    WITH {_STATUS_SQL}
    SELECT CAST(doc_id AS VARCHAR) AS id, created AS created_ts,
           md5(translate(shown, chr(9) || chr(10), '  ')) AS text_md5, 'name ' || doc_id % 100 AS user_name, source AS location,
           CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS verified, CAST(retweet AS VARCHAR) AS rt,
           coalesce(translate(quoted, chr(9) || chr(10), '  '), '') AS quoted_text
    FROM statuses WHERE doc_id % 3 < 2
    """,
)
def stream_append(spark, folder):
    statuses = live.parse_status(_documents(spark, folder).select(_status_json().alias("value")))
    out = scratch(spark, "lines")
    _finish(live.append_lines(live.line_columns(statuses), out, scratch(spark, "mark"), availableNow=True))
    lines = readers.read_delimited(spark, out, TWEET_STREAM, sep="\t")
    return lines.select(
        "id", "created_ts", F.md5("text").alias("text_md5"), F.col("`user.name`").alias("user_name"), "location",
        "verified", F.col("RT").alias("rt"), F.coalesce("quoted_text", F.lit("")).alias("quoted_text"),
    )


@query(
    "stream_upsert",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
)
def stream_upsert(spark, folder):
    schema = "user_id bigint, event_id bigint, event_type string, value double"
    arriving = scratch(spark, "arriving")
    # nine files, a batch each: enough to merge generations twice
    table(spark, folder, "events", "user_id", "event_id", "event_type", "value").repartition(
        9, "event_id"
    ).write.parquet(arriving)
    stream = live.file_stream(spark, arriving, schema, "*.parquet", files_per_batch=1)
    store = KeyedStore(spark, scratch(spark, "store"), schema, "user_id", "event_id")
    _finish(put_by_key(stream, store, scratch(spark, "mark"), availableNow=True))
    return store.read()
