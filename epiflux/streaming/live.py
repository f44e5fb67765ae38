"""Live messages: filter, projection and append sinks; ``keyed`` has the keyed store.

Streams are stateless; restart and exactly-once come from checkpoints and from
sinks that overwrite a repeated batch.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epiflux.functions.text import single_line
from epiflux.sources.schemas import TWEET_STATUS
from epiflux.sources.sinks import DELIMITED


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The parquet files of a named table: one file, or a folder of that name with files in it.

    The name goes in as a pattern, because a stream takes a plain path for a folder only.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}.parquet}}")


def tracks(text, phrases: list[str]) -> Column:
    """Whether a text holds all words of at least one phrase, in any case and order."""
    def tracked(folded: Column) -> Column:
        return reduce(or_, [reduce(and_, [folded.contains(w) for w in p.lower().split()]) for p in phrases])

    # exists over one element names the folded text, so that it is made once
    return F.exists(F.array(F.lower(F.col(text) if isinstance(text, str) else text)), tracked)


def keyword_filter(df: DataFrame, text: str, language: str, phrases: list[str], wanted: str = "en") -> DataFrame:
    return df.filter((F.col(language) == wanted) & tracks(text, phrases))


def parse_status(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON statuses as one ``status`` struct; unreadable lines drop out."""
    return df.select(F.from_json(value, TWEET_STATUS).alias("status")).filter("status.id IS NOT NULL")


def _full_text(status: str) -> Column:
    return F.coalesce(F.col(f"{status}.extended_tweet.full_text"), F.col(f"{status}.text"))


def _present(items: str, field: str) -> Column:
    values = F.col(f"status.entities.{items}.{field}")
    return F.filter(values, lambda value: value.isNotNull() & (value != ""))


def document_columns(statuses: DataFrame) -> DataFrame:
    """Statuses as flat documents for a keyed store."""
    return statuses.select(
        F.col("status.id").alias("id"),
        F.col("status.created_at").alias("created_at_utc"),
        _full_text("status").alias("text"),
        F.col("status.retweeted_status").isNotNull().cast("int").alias("retweet"),
        F.col("status.retweet_count").alias("retweet_count"),
        F.col("status.user.id").alias("user_id"),
        F.col("status.user.screen_name").alias("screen_name"),
        F.col("status.user.utc_offset").alias("utc_offset"),
        F.col("status.user.time_zone").alias("time_zone"),
        F.col("status.place.country_code").alias("place"),
        F.col("status.coordinates").alias("coordinates"),
        _present("hashtags", "text").alias("hashtags"),
        _present("user_mentions", "screen_name").alias("user_mentions"),
        _present("urls", "url").alias("urls"),
        _full_text("status.quoted_status").alias("quoted_text"),
    )


def line_columns(statuses: DataFrame, country: str = "US") -> DataFrame:
    """Statuses without a place or placed in ``country``, as one-line records."""
    code = F.col("status.place.country_code")
    kept = statuses.filter(code.isNull() | (code == country))
    return kept.select(
        F.col("status.id").cast("string").alias("id"),
        F.col("status.created_at").alias("created_ts"),
        single_line(_full_text("status")).alias("text"),
        F.col("status.user.name").alias("user.name"),
        F.col("status.user.location").alias("location"),
        F.col("status.user.verified").cast("string").alias("verified"),
        F.to_json("status.entities").alias("entities"),
        F.col("status.retweeted_status").isNotNull().cast("int").cast("string").alias("RT"),
        single_line(F.coalesce(_full_text("status.quoted_status"), F.lit(""))).alias("quoted_text"),
    )


def append_lines(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append tab-separated lines."""
    return (
        stream.writeStream.format("csv").outputMode("append").options(sep="\t", **DELIMITED)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start(path)
    )


def append_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append parquet files."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**trigger).start(path)
    )
