"""Text operators over messages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiflux.functions import text
from epiflux.functions.fixed_values import TERM_RULES
from epiflux.functions.places import code_flag, flag_code
from epiflux.operators import relational, vectorize
from epiflux.operators.messages import message_documents
from epiflux.operators.partitioning import spread
from epiflux.plans.bindings import MESSAGES_SQL, joined, messages, tokens_sql
from epiflux.plans.registry import query, sql_text
from epiflux.session import scratch, stored
from epiflux.sources import readers, schemas, sinks
from epiflux.sources.tables import fixed_table, table

NONWORDS_SQL = r"(?i)<[^>]+>|https?://[!$-_a-z]+|(?:\d+,?)+(?:\.?\d+)?"


def strip_sql(value: str) -> str:
    return f"regexp_replace({value}, '{NONWORDS_SQL}', '', 'g')"


def normalize_sql(value: str) -> str:
    for pattern, term in TERM_RULES:
        value = f"regexp_replace({value}, '{pattern}', '{term}', 'g')"
    return value


@query("strip_nonwords", f"SELECT page_id, {strip_sql('html')} AS text FROM pages")
def strip_nonwords(spark, folder):
    return table(spark, folder, "pages", "page_id", "html").select(
        "page_id", text.strip_nonwords("html").alias("text")
    )


@query("strip_message", f"WITH {MESSAGES_SQL} SELECT id, {strip_sql('text')} AS text FROM messages")
def strip_message(spark, folder):
    return messages(spark, folder).select("id", text.strip_nonwords("text").alias("text"))


@query("normalize_terms", f"WITH {MESSAGES_SQL} SELECT id, {normalize_sql('text')} AS text FROM messages")
def normalize_terms(spark, folder):
    return messages(spark, folder).select("id", text.normalize_terms("text").alias("text"))


@query(
    "emoticons",
    rf"""
    WITH {MESSAGES_SQL}
    SELECT id, array_to_string(regexp_extract_all(regexp_replace(text, 'https?://', '', 'g'),
           '[:=;][oO\-]?[D)\](/\\OpP]?'), '|') AS emoticons FROM messages
    """,
)
def emoticons(spark, folder):
    return messages(spark, folder).select("id", joined(text.emoticons("text")).alias("emoticons"))


@query(
    "hashtags",
    rf"""
    WITH {MESSAGES_SQL}
    SELECT id, array_to_string(regexp_extract_all(lower(text), '(?:^|\s)(#[\p{{L}}\p{{N}}_]+)', 1), '|') AS hashtags FROM messages
    """,
)
def hashtags(spark, folder):
    return messages(spark, folder).select("id", joined(text.hashtags("text")).alias("hashtags"))


ENTITY_TAGS_SQL = """
CASE id % 5 WHEN 0 THEN list_sort(['covid', source]) WHEN 1 THEN [''] WHEN 2 THEN NULL WHEN 3 THEN [''] ELSE ['menu'] END
"""


@query(
    "entity_hashtags",
    f"WITH {MESSAGES_SQL} SELECT id, array_to_string({ENTITY_TAGS_SQL}, '|') AS tags FROM messages",
)
def entity_hashtags(spark, folder):
    return messages(spark, folder).select("id", joined(text.entity_hashtags("entities")).alias("tags"))


DOCS_SQL = f"""
{MESSAGES_SQL},
period AS (
  SELECT *, CAST(created_ts - INTERVAL 8 HOUR AS DATE) AS local_dt, lower(text || coalesce(quoted_text, '')) AS all_text
  FROM messages WHERE created_ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-06'),
docs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY all_text ORDER BY id) AS rn FROM period) WHERE rn = 1)
"""


@query(
    "tweet_documents",
    f"""
    WITH {DOCS_SQL}
    SELECT id, local_dt, md5(all_text) AS text_md5, array_to_string({ENTITY_TAGS_SQL}, '|') AS tags FROM docs
    """,
)
def tweet_documents(spark, folder):
    docs = message_documents(messages(spark, folder), "2024-01-02", "2024-01-06")
    return docs.select("id", "local_dt", F.md5("all_text").alias("text_md5"), joined("tags").alias("tags"))


CLEAN_TOKENS_SQL = tokens_sql(normalize_sql(strip_sql("lower(text)")))


@query(
    "tokens_bigrams",
    f"""
    WITH t AS (SELECT doc_id, {CLEAN_TOKENS_SQL} AS w FROM documents)
    SELECT doc_id, array_to_string(w, '|') AS words,
           array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS pairs FROM t
    """,
)
def tokens_bigrams(spark, folder):
    docs = spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", text.tokens(text.prepare_text(F.lower("text"))).alias("w"))
    both = rows.withColumn("both", text.with_bigrams("w"))
    return both.select(
        "doc_id", joined("w").alias("words"),
        joined(F.slice("both", F.size("w") + 1, F.greatest(F.size("both"), F.lit(1)))).alias("pairs"),
    )


TERMS_SQL = f"""
words AS (SELECT doc_id, {CLEAN_TOKENS_SQL} AS w FROM documents),
terms AS (
  SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words),
counts AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY term
  HAVING count(*) >= 10 AND count(*) <= 0.9 * (SELECT count(*) FROM documents)
  ORDER BY total DESC, term LIMIT 10000)
"""


def document_terms(spark, folder):
    """Documents as written word texts, and the vocabulary kept of their words and bigrams."""
    docs = spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    rows = stored(docs.select("doc_id", vectorize.word_text(F.lower("text")).alias("words")), "document-words")
    return rows, vectorize.ngram_vocabulary(rows, "words")


def document_vectors(spark, folder):
    """``doc_id, at, n`` of the documents, and the vocabulary in column order; no term may be frequent enough."""
    rows, vocab = document_terms(spark, folder)
    names = [row.term for row in vocab.orderBy(F.desc("total"), "term").collect()]  # the vocabulary cap
    return vectorize.ngram_vectors(rows, "words", names), names, vocab


@query("doc_term_counts", f"WITH {TERMS_SQL} SELECT doc_id, term, n FROM counts WHERE term IN (SELECT term FROM vocab)")
def doc_term_counts(spark, folder):
    vectors, names, _ = document_vectors(spark, folder)
    cells = vectors.select("doc_id", F.inline(F.arrays_zip("at", "n")))
    listed = fixed_table(spark, enumerate(names), "at int, term string")
    return cells.join(F.broadcast(listed), "at").select("doc_id", "term", "n")


@query(
    "top_doc_freq_terms",
    f"WITH {TERMS_SQL} SELECT docs, term FROM vocab ORDER BY docs DESC, term DESC LIMIT 50",
)
def top_doc_freq_terms(spark, folder):
    _, vocab = document_terms(spark, folder)
    return vocab.orderBy(F.desc("docs"), F.desc("term")).limit(50).select("docs", "term")


@query(
    "doc_lengths_term_freq",
    f"""
    WITH {TERMS_SQL},
    kept AS (SELECT * FROM counts WHERE term IN (SELECT term FROM vocab))
    SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS name, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY doc_id
    UNION ALL SELECT 'term', term, CAST(sum(n) AS BIGINT) FROM kept GROUP BY term
    """,
)
def doc_lengths_term_freq(spark, folder):
    """The terms' counts are those of the vocabulary, the documents' are summed within their rows."""
    vectors, _, vocab = document_vectors(spark, folder)
    length = F.aggregate("n", F.lit(0).cast("bigint"), lambda total, n: total + n)
    docs = vectors.filter(F.size("at") > 0).groupBy(F.col("doc_id").cast("string").alias("name")).agg(F.sum(length).alias("n"))
    terms = vocab.select(F.lit("term").alias("kind"), F.col("term").alias("name"), F.col("total").alias("n"))
    return docs.select(F.lit("doc").alias("kind"), "name", "n").unionByName(terms)


@query(
    "hashtag_counts",
    rf"""
    WITH {MESSAGES_SQL},
    t AS (SELECT id, unnest({ENTITY_TAGS_SQL}) AS tag FROM messages),
    c AS (SELECT id, tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY ALL)
    SELECT id, tag, n FROM c WHERE tag IN (SELECT tag FROM c GROUP BY tag HAVING count(*) >= 5)
    """,
)
def hashtag_counts(spark, folder):
    rows = messages(spark, folder).select("id", text.entity_hashtags("entities").alias("tags"))
    counts = stored(vectorize.term_counts(rows, "id", "tags").filter("term <> ''"), "message-tags")
    total = table(spark, folder, "documents", "doc_id").agg(F.count(F.lit(1)))
    vocab = vectorize.vocabulary(counts, total, min_df=5, max_df=1.0, max_terms=None)
    return vectorize.in_vocabulary(counts, vocab, max_terms=None).select("id", F.col("term").alias("tag"), "n")


_FLAG_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FLAG_SIGNS = "".join(chr(0x1F1E6 + i) for i in range(26))


@query(
    "flag_to_country",
    f"""
    WITH p AS (
      SELECT c_custkey, r_name, CASE c_custkey % 3
        WHEN 0 THEN translate(left(r_name, 2), {sql_text(_FLAG_LETTERS)}, {sql_text(_FLAG_SIGNS)})
        WHEN 1 THEN 'fly ' || translate(left(r_name, 2), {sql_text(_FLAG_LETTERS)}, {sql_text(_FLAG_SIGNS)})
        ELSE r_name END AS place
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, place, CASE WHEN c_custkey % 3 = 0 THEN lower(r_name) END AS country FROM p
    """,
)
def flag_to_country(spark, folder):
    regions = table(spark, folder, "region")
    nations = table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    homes = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    flag, key = code_flag(F.left("r_name", F.lit(2))), F.col("c_custkey")
    places = customers.join(homes, customers.c_nationkey == homes.n_nationkey).select(
        "c_custkey",
        F.when(key % 3 == 0, flag).when(key % 3 == 1, F.concat(F.lit("fly "), flag)).otherwise(F.col("r_name")).alias("place"),
    )
    # two-letter codes: at most 676 rows, so the name table is safe to broadcast
    names = regions.groupBy(F.left("r_name", F.lit(2)).alias("code")).agg(F.min(F.lower("r_name")).alias("country"))
    return places.withColumn("code", flag_code("place")).join(F.broadcast(names), "code", "left").drop("code")


@query(
    "json_props",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
)
def json_props(spark, folder):
    return table(spark, folder, "events", "event_id", "props").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k")
    )


# Searched messages: the file of a search repeats an id where a message was found again later.
_SEARCHED_SQL = f"""
WITH {MESSAGES_SQL},
searched AS (
  SELECT id, created_ts, source AS user_name, CAST(id % 90 AS BIGINT) AS retweet_count, translate(text, chr(9) || chr(10), '  ') AS text
  FROM messages
  UNION ALL
  SELECT id, created_ts + INTERVAL 1 HOUR, source, CAST(id % 90 + 1 AS BIGINT), translate(text, chr(9) || chr(10), '  ')
  FROM messages WHERE id % 7 = 0)
"""


def _searched(spark, folder):
    """The searched messages, read from a tab-separated file with the published columns."""
    rows, again = messages(spark, folder), F.explode(
        F.when(F.col("id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    found = rows.withColumn("again", again).select(
        "id", text.single_line("text").alias("text"),
        (F.col("created_ts") + F.make_dt_interval(hours=F.col("again"))).alias("created_ts"),
        (F.col("id") % 1000).alias("user_id"), F.col("source").alias("user_name"),
        F.lower("source").alias("user_screen_name"), F.col("lang").alias("user_location"),
        (F.col("id") % 500).alias("user_statuses_count"), (F.col("id") % 11 == 0).alias("user_verified"),
        F.lit(0).alias("favorite_count"), F.lit(False).alias("favorited"),
        (F.col("id") % 90 + F.col("again")).alias("retweet_count"), "entities",
    )
    path = sinks.write_table(found, scratch(spark, "searched"), "tsv")
    return readers.read_delimited(spark, path, schemas.TWEET_SEARCH, sep="\t")


@query(
    "search_messages",
    f"{_SEARCHED_SQL} SELECT * FROM searched QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_ts) = 1",
)
def search_messages(spark, folder):
    """One row per id, its first by time, as a tab-separated file that is read again."""
    first = relational.keep_first(_searched(spark, folder), ["id"], [F.col("created_ts")])
    path = sinks.write_table(first, scratch(spark, "messages"), "tsv")
    kept = readers.read_delimited(spark, path, schemas.TWEET_SEARCH, sep="\t")
    return kept.select("id", "created_ts", "user_name", "retweet_count", "text")


@query(
    "search_repeats",
    f"{_SEARCHED_SQL} SELECT id, created_ts, user_name, retweet_count FROM searched WHERE id % 7 = 0",
)
def search_repeats(spark, folder):
    """Every row of an id that was found more than once."""
    repeated = relational.duplicates(_searched(spark, folder), [F.col("id")])
    return repeated.select("id", "created_ts", "user_name", "retweet_count")
