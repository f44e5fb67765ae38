"""Daily signal tables and keyed series."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiflux.functions.fixed_values import SUBJECT_HASHTAGS
from epiflux.functions.text import emoticons, hashtags, tokens
from epiflux.operators import daily, relational, series
from epiflux.operators.partitioning import spread
from epiflux.plans.bindings import (
    CASES_SQL, MESSAGES_SQL, cases, messages, tokens_sql,
)
from epiflux.plans.registry import query
from epiflux.session import scratch
from epiflux.sources import readers, schemas, sinks
from epiflux.sources.tables import table

_EVENT_COUNTS_SQL = "c AS (SELECT CAST(ts AS DATE) AS date, event_type AS term, count(*) AS volume FROM events GROUP BY 1, 2)"


def _event_counts(spark, folder):
    events = table(spark, folder, "events", "ts", "event_type")
    return daily.daily_counts(events, F.to_date("ts"), F.col("event_type"))


@query(
    "pivot_daily",
    f"""
    WITH {_EVENT_COUNTS_SQL}
    SELECT date, """
    + ", ".join(
        f"max(CASE WHEN term = '{t}' THEN volume END) AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM c GROUP BY date",
)
def pivot_daily(spark, folder):
    return daily.top_terms_pivot(_event_counts(spark, folder), 100)


_WORD_COUNTS_SQL = f"""
c AS (
  SELECT date, term, count(*) AS volume FROM (
    SELECT DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER) AS date, unnest({tokens_sql("lower(text)")}) AS term
    FROM documents) GROUP BY ALL)
"""


def _word_counts(spark, folder):
    docs = spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))
    return daily.daily_counts(docs, day, tokens(F.lower("text")))


@query(
    "top_terms_by_peak",
    f"""
    WITH {_WORD_COUNTS_SQL}
    SELECT term, max(volume) AS peak FROM c GROUP BY term ORDER BY peak DESC, term LIMIT 300
    """,
)
def top_terms_by_peak(spark, folder):
    return daily.top_by_peak(_word_counts(spark, folder), 300)


@query(
    "symptom_columns",
    f"""
    WITH {_WORD_COUNTS_SQL}
    SELECT * FROM (SELECT term, max(volume) AS peak FROM c GROUP BY term ORDER BY peak DESC, term LIMIT 125)
    WHERE regexp_matches(term, '[a-z]+')
    """,
)
def symptom_columns(spark, folder):
    return daily.top_by_peak(_word_counts(spark, folder), 125, keep="[a-z]+")


@query(
    "hashtag_columns",
    rf"""
    WITH {MESSAGES_SQL},
    c AS (
      SELECT date, term, count(*) AS volume FROM (
        SELECT created_dt AS date,
               unnest(regexp_extract_all(lower(text), '(?:^|\s)(#[\p{{L}}\p{{N}}_]+)', 1)) AS term FROM messages)
      GROUP BY ALL)
    SELECT term, max(volume) AS peak FROM c GROUP BY term HAVING NOT regexp_matches(term, '{SUBJECT_HASHTAGS}')
    """,
)
def hashtag_columns(spark, folder):
    rows = messages(spark, folder)
    counts = daily.daily_counts(rows, F.col("created_dt"), hashtags("text"))
    return daily.top_by_peak(counts, None, drop=SUBJECT_HASHTAGS)


# Wide daily tables: a published file of daily counts is read, cut to its columns, written as one JSON record per
# day, and read again.


def _published(spark, counts, schema):
    """Daily counts as a file with the published header, read back under the names used here."""
    names = [field.split()[0] for field in schema.split(", ")]
    path = sinks.write_table(counts.toDF(*names), scratch(spark, "daily-counts"), "csv")
    return readers.read_delimited(spark, path, schema).toDF("date", "term", "volume")


def _wide(spark, counts, n, keep=None, drop=None):
    """``date, term, volume`` of every cell of the wide JSON table."""
    records = daily.wide_records(counts, daily.top_names(counts, n, keep, drop))
    path = sinks.write_table(records, scratch(spark, "wide-daily"), "json")
    read = spark.read.schema("date date, volumes map<string,bigint>").json(path)
    return read.select("date", F.explode("volumes").alias("term", "volume"))


def _wide_sql(counts, n=None, where="true"):
    cut = f"ORDER BY peak DESC, term LIMIT {n}" if n else ""
    return f"""
    {counts},
    top AS (SELECT * FROM (SELECT term, max(volume) AS peak FROM c GROUP BY term {cut}) WHERE {where})
    SELECT date, term, volume FROM (SELECT DISTINCT date FROM c) CROSS JOIN (SELECT term FROM top)
    LEFT JOIN c USING (date, term)
    """


_EMOTICON_COUNTS_SQL = rf"""
WITH {MESSAGES_SQL},
c AS (
  SELECT date, term, count(*) AS volume FROM (
    SELECT created_dt AS date, unnest(regexp_extract_all(
      regexp_replace(text, 'https?://', '', 'g'), '[:=;][oO\-]?[D)\](/\\OpP]?')) AS term FROM messages)
  GROUP BY ALL)
"""
_TAG_COUNTS_SQL = rf"""
WITH {MESSAGES_SQL},
c AS (
  SELECT date, term, count(*) AS volume FROM (
    SELECT created_dt AS date,
           unnest(regexp_extract_all(lower(text), '(?:^|\s)(#[\p{{L}}\p{{N}}_]+)', 1)) AS term FROM messages)
  GROUP BY ALL)
"""


@query("wide_emojis", _wide_sql(_EMOTICON_COUNTS_SQL, 100))
def wide_emojis(spark, folder):
    counts = daily.daily_counts(messages(spark, folder), F.col("created_dt"), emoticons("text"))
    return _wide(spark, _published(spark, counts, schemas.EMOJI_DAILY), 100)


@query("wide_hashtags", _wide_sql(_TAG_COUNTS_SQL, where=f"NOT regexp_matches(term, '{SUBJECT_HASHTAGS}')"))
def wide_hashtags(spark, folder):
    counts = daily.daily_counts(messages(spark, folder), F.col("created_dt"), hashtags("text"))
    return _wide(spark, _published(spark, counts, schemas.HASHTAG_DAILY), None, drop=SUBJECT_HASHTAGS)


@query(
    "wide_symptoms",
    _wide_sql(f"""
    WITH by_lang AS (
      SELECT lang, date, term, count(*) AS volume FROM (
        SELECT lang, DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER) AS date, unnest({tokens_sql("lower(text)")}) AS term
        FROM documents) GROUP BY ALL),
    c AS (SELECT date, term, max(volume) AS volume FROM by_lang GROUP BY date, term)
    """, 125, "regexp_matches(term, '[a-z]+')"),
)
def wide_symptoms(spark, folder):
    """The published file repeats a symptom's day (here once per language); its highest volume stays."""
    docs = spread(table(spark, folder, "documents", "doc_id", "text", "lang"), "doc_id")
    words = docs.select(
        "lang", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).alias("date"),
        F.explode_outer(tokens(F.lower("text"))).alias("term")).filter("term IS NOT NULL")
    counts = words.groupBy("lang", "date", "term").agg(F.count(F.lit(1)).alias("volume")).drop("lang")
    read = _published(spark, counts, schemas.SYMPTOM_DAILY)
    highest = relational.keep_first(read, ["date", "term"], [-F.col("volume")])
    return _wide(spark, highest, 125, keep="[a-z]+")


@query("wide_terms", _wide_sql(f"WITH {_WORD_COUNTS_SQL}", 300))
def wide_terms(spark, folder):
    return _wide(spark, _published(spark, _word_counts(spark, folder), schemas.TERM_DAILY), 300)


@query(
    "peak_frequency",
    f"""
    WITH {_EVENT_COUNTS_SQL}
    SELECT term, max(volume) AS peak FROM c GROUP BY term ORDER BY peak DESC, term LIMIT 100
    """,
)
def peak_frequency(spark, folder):
    return daily.top_by_peak(_event_counts(spark, folder), 100)


@query(
    "daily_top_terms",
    f"""
    WITH c AS (
      SELECT date, term, count(*) AS volume FROM (
        SELECT DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS date, unnest({tokens_sql("lower(text)")}) AS term
        FROM conversations) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, term) AS rank FROM c)
    WHERE rank <= 10
    """,
)
def daily_top_terms(spark, folder):
    turns = table(spark, folder, "conversations", "conv_id", "text")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int"))
    return daily.daily_top_terms(daily.daily_counts(turns, day, tokens(F.lower("text"))), 10)


@query(
    "daily_sentiment_index",
    "SELECT CAST(ts AS DATE) AS date, round(avg(value), 6) AS sentiment_score FROM events GROUP BY 1",
)
def daily_sentiment_index(spark, folder):
    events = table(spark, folder, "events", "ts", "value")
    return events.groupBy(F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 6).alias("sentiment_score"))


@query(
    "daily_new_cases",
    f"""
    WITH {CASES_SQL}
    SELECT county, date, confirmed, confirmed - lag(confirmed) OVER (PARTITION BY county ORDER BY date) AS new_cases
    FROM cases
    """,
)
def daily_new_cases(spark, folder):
    return series.new_cases(cases(spark, folder), "county", "date", "confirmed")


_WEIGHTS = [(k, f"exp(-0.5 * ({k} / 2.0) * ({k} / 2.0))") for k in range(-3, 4)]


def _cell(k):
    return f"lag(new_cases, {-k}) OVER w" if k < 0 else f"lead(new_cases, {k}) OVER w"


SMOOTH_SQL = f"""
{CASES_SQL},
fresh AS (
  SELECT *, confirmed - lag(confirmed) OVER (PARTITION BY county ORDER BY date) AS new_cases FROM cases),
smooth AS (
  SELECT county, date, new_cases, round_even(
    ({" + ".join(f"coalesce({w} * {_cell(k)}, 0)" for k, w in _WEIGHTS)})
    / ({" + ".join(f"CASE WHEN {_cell(k)} IS NOT NULL THEN {w} ELSE 0 END" for k, w in _WEIGHTS)}), 0) AS smoothed
  FROM fresh WINDOW w AS (PARTITION BY county ORDER BY date)),
prepared AS (
  SELECT * FROM smooth JOIN (
    SELECT county, min(date) AS start FROM smooth WHERE smoothed >= 5 GROUP BY county) USING (county)
  WHERE date >= start)
"""


@query("gaussian_smooth", f"WITH {SMOOTH_SQL} SELECT county, date, new_cases, smoothed FROM smooth")
def gaussian_smooth(spark, folder):
    fresh = series.new_cases(cases(spark, folder), "county", "date", "confirmed")
    return series.gaussian_smooth(fresh, "county", "date", "new_cases").drop("confirmed")


@query(
    "case_onset_cut",
    f"""
    WITH {CASES_SQL},
    s AS (SELECT county, min(date) AS start FROM cases WHERE confirmed >= 400 GROUP BY county)
    SELECT county, date, confirmed FROM cases JOIN s USING (county) WHERE date >= start
    """,
)
def case_onset_cut(spark, folder):
    return series.onset_cut(cases(spark, folder), "county", "date", "confirmed", 400)


@query("rt_prepare", f"WITH {SMOOTH_SQL} SELECT county, date, new_cases, smoothed FROM prepared")
def rt_prepare(spark, folder):
    return series.prepare_cases(cases(spark, folder), "county", "date", "confirmed", cutoff=5)
