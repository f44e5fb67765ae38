"""Preparing a collection of messages for counting and modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiflux.functions.text import entity_hashtags
from epiflux.operators.relational import date_window, keep_first_text


def message_documents(
    messages: DataFrame, start, end, zone: str = "US/Pacific", date_column: str = "created_ts",
    drop_repeats: bool = True,
) -> DataFrame:
    """Messages of a period with local date, full lower-case text and hashtags.

    The period is cut on the stored UTC time, before the shift to local time.
    Quoted text is appended without a space.  Of equal texts the lowest id stays.
    A date given as text is parsed; what does not parse is outside every period.
    """
    if dict(messages.dtypes)[date_column] == "string":
        messages = messages.withColumn(date_column, F.try_to_timestamp(F.col(date_column)))
    chosen = date_window(messages, date_column, start, end)
    local = F.from_utc_timestamp(F.col(date_column), zone)
    docs = chosen.select(
        *messages.columns,
        F.to_date(local).alias("local_dt"),
        F.lower(F.concat("text", F.coalesce("quoted_text", F.lit("")))).alias("all_text"),
    ).filter(F.col("all_text").isNotNull())
    if drop_repeats:
        docs = keep_first_text(docs, "all_text", [F.col("id")])
    return docs.withColumn("tags", entity_hashtags("entities"))
