"""Sources, filters, joins, unions, roll-ups and statistics over the plain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from epiflux.operators import matching, places, relational, rt, statistics
from epiflux.plans.bindings import RATIOS_SQL, joined
from epiflux.plans.registry import query
from epiflux.session import scratch
from epiflux.sources import readers, sinks
from epiflux.sources.tables import catalog_table, fixed_table, save_catalog_table, sql_over, table

# ---------------------------------------------------------------- sources and sinks


@query(
    "tsv_glob_scan",
    "SELECT event_id, event_type, value, CAST(ts AS DATE) AS day FROM events",
)
def tsv_glob_scan(spark, folder):
    events = table(spark, folder, "events", "event_id", "event_type", "value", "ts")
    path = sinks.write_table(events.withColumn("ts", F.col("ts").cast("string")), scratch(spark, "tsv"), "tsv")
    rows = readers.read_delimited(
        spark, f"{path}/part-*", "event_id bigint, event_type string, value double, ts string", sep="\t"
    )
    return rows.select("event_id", "event_type", "value", F.try_to_date(F.substring("ts", 1, 10)).alias("day"))


@query(
    "positional_schema_scan",
    "SELECT event_id AS profile, event_type AS kind, user_id AS age, value AS temperature FROM events",
)
def positional_schema_scan(spark, folder):
    events = table(spark, folder, "events", "event_id", "event_type", "user_id", "value")
    path = sinks.write_table(events, scratch(spark, "csv"), "csv")
    return readers.read_delimited(spark, path, "profile bigint, kind string, age bigint, temperature double")


@query(
    "format_roundtrip",
    """
    SELECT 'json' AS format, c_custkey, c_name, c_acctbal FROM customer
    UNION ALL SELECT 'parquet', c_custkey, c_name, c_acctbal FROM customer
    """,
)
def format_roundtrip(spark, folder):
    schema = "c_custkey bigint, c_name string, c_acctbal double"
    customers = table(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal")
    csv = sinks.write_table(customers, scratch(spark, "csv"), "csv")
    back = []
    for fmt in ("json", "parquet"):
        out = scratch(spark, fmt)
        sinks.convert_csv(spark, csv, out, fmt, schema)
        back.append(spark.read.schema(schema).format(fmt).load(out).withColumn("format", F.lit(fmt)))
    return relational.union_sparse(back)


@query(
    "header_discovery",
    r"""
    SELECT doc_id, len(string_split(text, chr(10))) AS header_line,
           'ISO|' || lang || '|' || source AS names
    FROM documents
    """,
)
def header_discovery(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    note = F.concat(
        F.col("text"), F.lit("\n#ISO\t"), F.col("lang"), F.lit("\t "), F.col("source"), F.lit("\t\nAD\t1\t2")
    )
    at, names = readers.header_columns(note, r"^#ISO", "\t")
    return documents.select(
        "doc_id", at.alias("header_line"), F.regexp_replace(joined(names), "^#", "").alias("names")
    )


_README = """Customer dump
=============
Tab-delimited, one customer a line.

The main 'customer' table has the following fields :
---------------------------------------------------
customer id       : integer id of the record
name              : name of the customer (utf8)
nation            : key of the nation,
                    see below
balance           : account balance : may be negative
market segment    :

NationCodes:
key   : not a column of the main table
"""


@query(
    "readme_columns",
    "SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer",
)
def readme_columns(spark, folder):
    """A headerless dump read by the names that its readme lists."""
    readme, dump = scratch(spark, "readme"), scratch(spark, "dump")
    fixed_table(spark, [(_README,)], "value string").coalesce(1).write.text(readme)
    customers = table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    customers.write.options(sep="\t", escape='"', header=False).csv(dump)
    rows = readers.read_by_listing(
        spark, readme, dump, "^The main 'customer' table has the following fields", "^NationCodes:",
        {"customer id": "bigint", "nation": "bigint", "balance": "double"})
    return rows.select(
        F.col("`customer id`").alias("customer_id"), "name", "nation", "balance", F.col("`market segment`").alias("segment"))


@query(
    "catalog_by_state",
    "SELECT c_custkey, c_name, c_acctbal, c_mktsegment AS state FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def catalog_by_state(spark, folder):
    """A table written and read by name; the condition prunes all folders but one."""
    customers = table(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    name = f"customers_{uuid.uuid4().hex}"
    save_catalog_table(customers.withColumnRenamed("c_mktsegment", "state"), name, scratch(spark, "catalog"), "state")
    return catalog_table(spark, name, F.col("state") == "BUILDING")


@query(
    "census_long",
    """
    WITH areas AS (
      SELECT n_name AS area, c_nationkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT area, measure, CAST(value AS DOUBLE) AS value FROM (
      SELECT area, 'census' AS measure, sum(CAST(floor(c_acctbal * 100) AS BIGINT)) AS value FROM areas GROUP BY area
      UNION ALL SELECT area, 'estimate', count(*) * 1000 FROM areas GROUP BY area
      UNION ALL SELECT area, 'change', CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE -1234 END
      FROM areas GROUP BY area, c_nationkey
      UNION ALL SELECT area, 'ranking', NULL FROM areas GROUP BY area)
    """,
)
def census_long(spark, folder):
    customers = table(spark, folder, "customer", "c_nationkey", "c_acctbal")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name")
    totals = customers.groupBy("c_nationkey").agg(
        F.sum(F.floor(F.col("c_acctbal") * 100)).alias("money"), F.count(F.lit(1)).alias("people")
    )
    sheet = totals.join(nations, totals.c_nationkey == nations.n_nationkey).select(
        F.concat(F.lit("."), "n_name").alias("area"),
        F.format_number("money", 0).alias("a"),
        F.format_number(F.col("people") * 1000, 0).alias("b"),
        F.when(F.col("c_nationkey") % 2 == 0, "-").otherwise("-1,234").alias("c"),
        F.lit("(X)").alias("d"),
    )
    notes = spark.createDataFrame(
        [
            ("table with row headers in column A\nand column headers in rows 3 through 5", "", "", "", ""),
            (".Geographic Area", "Population Estimate \n(as of July 1)", "", "Change", "Ranking"),
            ("", "Census", "Estimates Base", "Number", "Rank"),
            ("", "", "", "", ""),
            ("Dash (-) represents zero or rounds to zero. ", "", "", "", ""),
            ("Note: estimates, see \"terms\", and definitions.", "", "", "", ""),
        ],
        sheet.schema,
    )
    path = scratch(spark, "census")
    notes.union(sheet).write.option("escape", '"').csv(path)
    return readers.read_census(spark, path, ["census", "estimate", "change", "ranking"])


@query(
    "grep_lines",
    r"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)
    WHERE regexp_matches(l[i], '[0-9]{3}')
    """,
)
def grep_lines(spark, folder):
    return readers.grep_column(table(spark, folder, "documents", "doc_id", "text"), "text", r"[0-9]{3}")


@query(
    "grep_files",
    r"""
    SELECT CAST(count(*) AS BIGINT) AS n_lines FROM (
      SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[0-9]{3}')
    """,
)
def grep_files(spark, folder):
    path = scratch(spark, "lines")
    table(spark, folder, "documents", "text").write.text(path)
    return readers.grep_files(spark, path, r"[0-9]{3}").agg(F.count("line_no").alias("n_lines"))


@query(
    "first_capture",
    r"""
    WITH hits AS (
      SELECT doc_id, text, list_filter(string_split(text, chr(10)),
             lambda s: regexp_matches(s, '[,.]\s+(\p{L}+)'))[1] AS hit FROM documents)
    SELECT doc_id,
           CASE WHEN hit IS NOT NULL THEN regexp_extract(hit, '[,.]\s+(\p{L}+)', 1) END AS in_line,
           CASE WHEN regexp_matches(text, '[,.]\s+(\p{L}+)') THEN regexp_extract(text, '[,.]\s+(\p{L}+)', 1) END AS in_text
    FROM hits
    """,
)
def first_capture(spark, folder):
    pattern = r"[,.]\s+(\p{L}+)"
    return table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        readers.first_line_capture("text", pattern).alias("in_line"),
        readers.text_capture("text", pattern).alias("in_text"),
    )


@query(
    "sql_filter_limit",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100",
)
def sql_filter_limit(spark, folder):
    return sql_over(
        spark,
        "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100",
        customer=table(spark, folder, "customer"),
    )


# ---------------------------------------------------------------- projections and filters


@query(
    "select_columns_like",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
)
def select_columns_like(spark, folder):
    orders = table(spark, folder, "orders")
    chosen = orders.select(relational.columns_like(orders, "order", without=("o_orderstatus",)))
    return chosen.withColumn("o_orderdate", F.to_date("o_orderdate"))


@query(
    "valid_id_split",
    r"""
    WITH ids AS (
      SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN NULL WHEN 2 THEN 'id' || doc_id
                     ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents)
    SELECT doc_id, id, CASE WHEN regexp_matches(id, '[0-9]') THEN 'kept' ELSE 'rejected' END AS outcome FROM ids
    """,
)
def valid_id_split(spark, folder):
    key = F.col("doc_id")
    ids = table(spark, folder, "documents", "doc_id").withColumn(
        "id",
        F.when(key % 7 == 0, "abc").when(key % 7 == 1, None).when(key % 7 == 2, F.concat(F.lit("id"), key))
        .otherwise(key.cast("string")),
    )
    kept, rejected = relational.split_valid(ids, "id")
    return kept.withColumn("outcome", F.lit("kept")).union(rejected.withColumn("outcome", F.lit("rejected")))


@query(
    "complete_cases",
    """
    SELECT c_custkey, age, male FROM (
      SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 90 END AS age,
             CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 END AS male FROM customer)
    WHERE age IS NOT NULL AND male IS NOT NULL
    """,
)
def complete_cases(spark, folder):
    key = F.col("c_custkey")
    people = table(spark, folder, "customer", "c_custkey").withColumns(
        {"age": F.when(key % 5 != 0, key % 90), "male": F.when(key % 7 != 0, key % 2)}
    )
    return people.dropna(subset=["age", "male"])


@query(
    "range_filter",
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-05' AND TIMESTAMP '1996-09-10'
    """,
)
def range_filter(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate")
    rows = relational.date_window(orders, "o_orderdate", "1996-03-05", "1996-09-10")
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query(
    "null_or_eq_filter",
    """
    WITH places AS (
      SELECT event_id, CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3
                       WHEN 1 THEN 'US' WHEN 2 THEN 'GB' END AS country_code FROM events)
    SELECT event_id, country_code FROM places WHERE country_code IS NULL OR country_code = 'US'
    """,
)
def null_or_eq_filter(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    events = table(spark, folder, "events", "event_id", "props").select(
        "event_id", F.when(k % 3 == 1, "US").when(k % 3 == 2, "GB").alias("country_code")
    )
    return events.filter(F.col("country_code").isNull() | (F.col("country_code") == "US"))


@query(
    "split_key",
    """
    SELECT s_suppkey, split_part(k, '-', 1) AS state, split_part(k, '-', 2) AS county FROM (
      SELECT s_suppkey, n_name || '-' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN '-east' ELSE '' END AS k
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    """,
)
def split_key(spark, folder):
    suppliers = table(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name")
    key = F.concat(
        "n_name", F.lit("-"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, "-east").otherwise("")
    )
    keyed = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", key.alias("key"))
    return rt.split_county(keyed, "key").select("s_suppkey", "state", "county")


# ---------------------------------------------------------------- joins


@query(
    "daily_full_outer",
    """
    WITH cases AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS death_cnt FROM orders GROUP BY 1),
    mobility AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS tweet_volume
                 FROM lineitem GROUP BY 1),
    sentiment AS (SELECT CAST(ts AS DATE) AS date, round(avg(value), 6) AS sentiment_score FROM events GROUP BY 1)
    SELECT date, death_cnt, tweet_volume, sentiment_score
    FROM cases FULL JOIN mobility USING (date) FULL JOIN sentiment USING (date)
    """,
)
def daily_full_outer(spark, folder):
    cases = table(spark, folder, "orders", "o_orderdate").groupBy(
        F.to_date("o_orderdate").alias("date")
    ).agg(F.count(F.lit(1)).alias("deaths"))
    mobility = table(spark, folder, "lineitem", "l_shipdate", "l_quantity").groupBy(
        F.to_date("l_shipdate").alias("date")
    ).agg(F.sum("l_quantity").cast("bigint").alias("tweet_volume"))
    sentiment = table(spark, folder, "events", "ts", "value").groupBy(
        F.to_date("ts").alias("date")
    ).agg(F.round(F.avg("value"), 6).alias("vdr_compound"))
    return relational.outer_by_key(
        [
            cases.withColumnsRenamed({"deaths": "death_cnt"}),
            mobility,
            sentiment.withColumnsRenamed({"vdr_compound": "sentiment_score"}),
        ],
        "date",
    )


@query(
    "country_daily",
    """
    WITH c AS (SELECT CAST(o_orderdate AS DATE) AS date, n_name AS country_region, count(*) AS death_cnt
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
               GROUP BY 1, 2),
    v AS (SELECT CAST(ts AS DATE) AS date, count(*) AS tweet_volume FROM events GROUP BY 1)
    SELECT date, country_region, death_cnt, tweet_volume FROM v FULL JOIN c USING (date)
    """,
)
def country_daily(spark, folder):
    orders = table(spark, folder, "orders", "o_orderdate", "o_custkey")
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name")
    # count per customer and day before the join, so a busy customer is a few rows
    per_customer = orders.groupBy(F.to_date("o_orderdate").alias("date"), "o_custkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "date", "c_nationkey"
    ).agg(F.sum("n").alias("death_cnt"))
    cases = counts.join(nations, counts.c_nationkey == nations.n_nationkey).select(
        "date", F.col("n_name").alias("country_region"), "death_cnt"
    )
    volume = table(spark, folder, "events", "ts").groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("tweet_volume")
    )
    return volume.join(cases, "date", "full")


@query(
    "dim_lookup",
    """
    SELECT s_suppkey, coalesce(n_name, '') AS country FROM supplier
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON s_nationkey = n_nationkey
    """,
)
def dim_lookup(spark, folder):
    known = table(spark, folder, "nation", "n_nationkey", "n_name").filter("n_nationkey % 4 <> 0")
    suppliers = table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    return suppliers.join(known, suppliers.s_nationkey == known.n_nationkey, "left").select(
        "s_suppkey", F.coalesce("n_name", F.lit("")).alias("country")
    )


@query(
    "alt_name_join",
    """
    SELECT c_custkey, c_name AS alt_name, n_name AS country, n_regionkey AS iso, lang FROM (
      SELECT c_custkey, c_name, c_nationkey,
             CASE c_custkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fra' WHEN 2 THEN 'link' WHEN 3 THEN '' END AS lang
      FROM customer) JOIN nation ON c_nationkey = n_nationkey
    WHERE regexp_matches(lang, '^[a-zA-Z]{2,3}$')
    """,
)
def alt_name_join(spark, folder):
    key = F.col("c_custkey")
    names = table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey").withColumn(
        "lang",
        F.when(key % 5 == 0, "en").when(key % 5 == 1, "fra").when(key % 5 == 2, "link").when(key % 5 == 3, ""),
    )
    alternates = names.select(
        "c_custkey", F.col("c_nationkey").alias("geonameid"), F.col("c_name").alias("name"), F.col("lang").alias("language")
    )
    countries = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("geonameid"), F.col("n_regionkey").alias("code"), F.col("n_name").alias("country")
    )
    # names of customers are their keys in text
    return places.join_alternate_names(alternates, countries).select(
        F.regexp_extract("name", "[0-9]+", 0).cast("bigint").alias("c_custkey"), F.col("name").alias("alt_name"), "country",
        F.col("code").alias("iso"), F.col("language").alias("lang"),
    )


_TOKENS_SQL = """
tokens AS (
  SELECT s_suppkey, n_regionkey AS country_code,
         CASE s_suppkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(lower(n_name), 'tio', 'to')
              WHEN 2 THEN lower(n_name) || ' st' ELSE 'zz' || s_suppkey END AS token
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def _state_tokens(spark, folder):
    suppliers = table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey")
    key, name = F.col("s_suppkey"), F.lower("n_name")
    return suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select(
        "s_suppkey", F.col("n_regionkey").alias("country_code"),
        F.when(key % 4 == 0, name).when(key % 4 == 1, F.replace(name, F.lit("tio"), F.lit("to")))
        .when(key % 4 == 2, F.concat(name, F.lit(" st"))).otherwise(F.concat(F.lit("zz"), key)).alias("token"),
    )


def _states(spark, folder):
    return table(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey").select(
        F.col("n_regionkey").alias("country_code"), F.col("n_name").alias("asciiname"),
        F.concat(F.lit("n"), "n_nationkey").alias("admin1_code"),
    )


@query(
    "fuzzy_state_match",
    f"""
    WITH RECURSIVE {_TOKENS_SQL},
    compared AS (SELECT DISTINCT token AS p, lower(n_name) AS c FROM tokens JOIN nation ON country_code = n_regionkey),
    {RATIOS_SQL},
    best AS (
      SELECT s_suppkey, country_code, token, c AS state, 'N' || n_nationkey AS code, score,
             row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c) AS rn
      FROM tokens JOIN nation ON country_code = n_regionkey JOIN ratios ON token = p AND lower(n_name) = c)
    SELECT s_suppkey, country_code, token, CASE WHEN score > 75 THEN score END AS score,
           CASE WHEN score > 75 THEN state END AS state_name, CASE WHEN score > 75 THEN code END AS state_code
    FROM best WHERE rn = 1
    """,
)
def fuzzy_state_match(spark, folder):
    return matching.fuzzy_states(_state_tokens(spark, folder), _states(spark, folder))


@query(
    "fuzzy_state_edit",
    f"""
    WITH {_TOKENS_SQL},
    scored AS (
      SELECT s_suppkey, country_code, token, lower(n_name) AS state, 'N' || n_nationkey AS code,
             CAST(floor(100.0 * (greatest(length(token), length(n_name)) - levenshtein(token, lower(n_name)))
                  / greatest(length(token), length(n_name)) + 0.5) AS INTEGER) AS score
      FROM tokens JOIN nation ON country_code = n_regionkey),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, state) AS rn FROM scored)
    SELECT s_suppkey, country_code, token, CASE WHEN score > 75 THEN score END AS score,
           CASE WHEN score > 75 THEN state END AS state_name, CASE WHEN score > 75 THEN code END AS state_code
    FROM best WHERE rn = 1
    """,
)
def fuzzy_state_edit(spark, folder):
    return matching.fuzzy_states(_state_tokens(spark, folder), _states(spark, folder), by="edits")


@query(
    "alias_best_score",
    """
    WITH a AS (
      SELECT p_partkey, lower(p_brand) AS pattern,
             list_sort([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'brand' || p_size, lower(p_type)]) AS aliases
      FROM part),
    s AS (
      SELECT p_partkey, x AS choice,
             CAST(floor(100.0 * (greatest(length(pattern), length(x)) - levenshtein(pattern, x))
                  / greatest(length(pattern), length(x)) + 0.5) AS INTEGER) AS score
      FROM a, unnest(aliases) AS t(x))
    SELECT p_partkey, max(score) AS score, arg_min(choice, (-score, choice)) AS choice FROM s GROUP BY p_partkey
    """,
)
def alias_best_score(spark, folder):
    parts = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_type")
    words = F.split("p_name", " ")
    rows = parts.select(
        "p_partkey", F.lower("p_brand").alias("pattern"),
        F.array(
            words.getItem(0), words.getItem(1), F.concat(F.lit("brand"), "p_size"), F.lower("p_type")
        ).alias("aliases"),
    )
    return matching.alias_scores(rows, "pattern", "aliases").select("p_partkey", "score", "choice")


@query(
    "ngram_cosine_join",
    """
    WITH p AS (SELECT DISTINCT lower(p_brand) || ' ' || p_name AS pattern FROM part),
    c AS (SELECT DISTINCT p_name AS choice FROM part),
    pg AS (SELECT pattern, list_distinct(list_transform(range(1, length(pattern) - 1), lambda i: pattern[i:i+2])) AS g FROM p),
    cg AS (SELECT choice, list_distinct(list_transform(range(1, length(choice) - 1), lambda i: choice[i:i+2])) AS g FROM c),
    s AS (SELECT pattern, choice, len(list_intersect(pg.g, cg.g)) / sqrt(CAST(len(pg.g) * len(cg.g) AS DOUBLE)) AS score
          FROM pg, cg),
    r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY score DESC, choice) AS rn FROM s WHERE score >= 0.5)
    SELECT pattern, choice, round(score, 9) AS score FROM r WHERE rn = 1
    """,
)
def ngram_cosine_join(spark, folder):
    parts = table(spark, folder, "part", "p_name", "p_brand")
    patterns = parts.select(F.concat(F.lower("p_brand"), F.lit(" "), "p_name").alias("name"))
    best = matching.ngram_best_match(patterns, "name", parts, "p_name", n=3)
    return best.withColumn("score", F.round("score", 9))


# ---------------------------------------------------------------- roll-ups and statistics


@query(
    "value_counts_multi",
    """
    WITH o AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status, o_orderpriority AS priority FROM orders)
    SELECT 'status' AS "column", status AS value, count(*) AS n FROM o GROUP BY status
    UNION ALL SELECT 'priority', priority, count(*) FROM o GROUP BY priority
    """,
)
def value_counts_multi(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = orders.select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return relational.value_counts(rows, ["status", "priority"])


@query(
    "scalar_stats",
    """
    SELECT (SELECT median(p_size) FROM part) AS median_size,
           (SELECT CAST(min(ts) AS DATE) FROM events) AS first_day,
           (SELECT CAST(max(ts) AS DATE) FROM events) AS last_day,
           (SELECT round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) FROM events) AS click_share
    """,
)
def scalar_stats(spark, folder):
    parts = table(spark, folder, "part", "p_size")
    events = table(spark, folder, "events", "ts", "event_type")
    median = statistics.exact_quantiles(parts, "p_size", [0.5]).select("q0").scalar()
    return events.agg(
        F.to_date(F.min("ts")).alias("first_day"),
        F.to_date(F.max("ts")).alias("last_day"),
        F.round(F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)), 6).alias("click_share"),
    ).withColumn("median_size", median)


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count({name}) AS count, round(avg({name}), 6) AS mean,
        round(stddev_samp({name}), 6) AS std, CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max,
        round(quantile_cont(CAST({name} AS DOUBLE), 0.25), 6) AS p25,
        round(quantile_cont(CAST({name} AS DOUBLE), 0.5), 6) AS p50,
        round(quantile_cont(CAST({name} AS DOUBLE), 0.75), 6) AS p75 FROM part"""
        for name in ("p_size", "p_retailprice")
    ),
)
def describe_numeric(spark, folder):
    stats = statistics.describe_columns(
        table(spark, folder, "part", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]
    )
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query(
    "histogram",
    """
    WITH s AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem)
    SELECT CAST(least(floor((l_extendedprice - low) * 50 / (high - low)), 49) AS INTEGER) AS bin, count(*) AS n
    FROM lineitem, s GROUP BY 1
    """,
)
def histogram(spark, folder):
    return statistics.histogram(table(spark, folder, "lineitem", "l_extendedprice"), "l_extendedprice", 50)


@query(
    "collect_set_rollup",
    """
    SELECT c_nationkey, c_mktsegment || c_custkey % 40 AS member, count(*) AS n FROM customer GROUP BY ALL
    """,
)
def collect_set_rollup(spark, folder):
    customers = table(spark, folder, "customer", "c_nationkey", "c_custkey", "c_mktsegment").select(
        "c_nationkey", F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("name")
    )
    return relational.rollup_members(customers, ["c_nationkey"], "name")


@query(
    "string_rollup",
    """
    SELECT c_nationkey, c_mktsegment AS member, count(*) AS n FROM customer GROUP BY ALL
    """,
)
def string_rollup(spark, folder):
    """The members of each key with the times they repeat."""
    customers = table(spark, folder, "customer", "c_nationkey", "c_mktsegment")
    return relational.rollup_members(customers, ["c_nationkey"], "c_mktsegment")


@query(
    "union_sparse",
    """
    SELECT n_name AS asciiname, n_nationkey AS nationkey, n_regionkey AS regionkey, NULL AS population FROM nation
    UNION ALL SELECT r_name, NULL, r_regionkey, NULL FROM region
    UNION ALL SELECT s_name, s_nationkey, NULL, CAST(floor(s_acctbal) AS BIGINT) FROM supplier
    """,
)
def union_sparse(spark, folder):
    nations = table(spark, folder, "nation").withColumnsRenamed(
        {"n_name": "asciiname", "n_nationkey": "nationkey", "n_regionkey": "regionkey"}
    )
    regions = table(spark, folder, "region").withColumnsRenamed(
        {"r_name": "asciiname", "r_regionkey": "regionkey"}
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_name").alias("asciiname"), F.col("s_nationkey").alias("nationkey"),
        F.floor("s_acctbal").alias("population"),
    )
    return relational.union_sparse([nations, regions, suppliers])


# ---------------------------------------------------------------- ranking


@query(
    "dual_rank_first",
    """
    SELECT p_partkey, p_type, p_size, p_retailprice FROM (
      SELECT *, rank() OVER (PARTITION BY p_type ORDER BY p_size) AS a,
             rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS b
      FROM (SELECT p_partkey, p_type, p_size % 3 AS p_size, floor(p_retailprice / 90) AS p_retailprice FROM part))
    WHERE a = 1 AND b = 1
    """,
)
def dual_rank_first(spark, folder):
    parts = table(spark, folder, "part", "p_partkey", "p_type", "p_size", "p_retailprice").withColumns(
        {"p_size": F.col("p_size") % 3, "p_retailprice": F.floor(F.col("p_retailprice") / 90).cast("double")}
    )
    return relational.first_in_both(parts, "p_type", "p_size", "p_retailprice").select(
        "p_partkey", "p_type", "p_size", "p_retailprice"
    )


@query(
    "best_match",
    """
    WITH m AS (
      SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 > 0 THEN 1.0 END AS score,
             CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS hierarchy,
             CASE WHEN p_size % 7 > 0 THEN p_retailprice END AS population FROM part)
    SELECT p_brand, p_partkey FROM (
      SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC NULLS LAST, hierarchy ASC NULLS LAST,
             population DESC NULLS LAST, p_partkey) AS rn FROM m) WHERE rn = 1
    """,
)
def best_match(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, folder, "part", "p_partkey", "p_brand", "p_size", "p_retailprice").select(
        "p_brand", "p_partkey", F.when(key % 3 > 0, 1.0).alias("score"),
        F.when(size % 5 > 0, size % 5).alias("hierarchy"),
        F.when(size % 7 > 0, F.col("p_retailprice")).alias("population"),
    )
    order = [
        *relational.nulls_last(-F.col("score")), *relational.nulls_last(F.col("hierarchy")),
        *relational.nulls_last(-F.col("population")), key,
    ]
    return relational.keep_first(rows, ["p_brand"], order).select("p_brand", "p_partkey")


@query(
    "dedupe_keep_first",
    """
    SELECT date, symptom, volume FROM (
      SELECT CAST(ts AS DATE) AS date, event_type AS symptom, value AS volume,
             row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY value DESC, event_id) AS rn FROM events)
    WHERE rn = 1
    """,
)
def dedupe_keep_first(spark, folder):
    events = table(spark, folder, "events", "event_id", "ts", "event_type", "value").select(
        F.to_date("ts").alias("date"), F.col("event_type").alias("symptom"), F.col("value").alias("volume"), "event_id"
    )
    first = relational.keep_first(events, ["date", "symptom"], [-F.col("volume"), F.col("event_id")])
    return first.drop("event_id")


@query(
    "show_duplicates",
    """
    WITH keyed AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 50 > 0 THEN text END AS key FROM documents)
    SELECT doc_id, lang, source FROM keyed
    WHERE key IN (SELECT key FROM keyed GROUP BY key HAVING count(*) > 1) OR key IS NULL
    """,
)
def show_duplicates(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    key = F.when(F.col("doc_id") % 50 > 0, F.sha2("text", 256))  # some rows have no key
    repeated = relational.duplicates(documents, [key])
    return repeated.select("doc_id", "lang", "source")


@query(
    "keep_first_by_id",
    "SELECT min(doc_id) AS doc_id, min(n_chars) AS n_chars FROM documents GROUP BY text",
)
def keep_first_by_id(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "text", "n_chars")
    return relational.keep_first_text(documents, "text", [F.col("doc_id")]).select("doc_id", "n_chars")
