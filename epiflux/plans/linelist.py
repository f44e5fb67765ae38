"""Cleaning a patient line list."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiflux.functions import cleaning
from epiflux.functions.fixed_values import MARKET_EXPOSURE, OUTCOME_GROUPS, REGION_TO_COUNTRY, SEX_CODES
from epiflux.operators import linelist, statistics
from epiflux.plans.registry import query, sql_list, sql_text
from epiflux.session import scratch
from epiflux.sources import readers, sinks
from epiflux.sources.schemas import LINELIST
from epiflux.sources.tables import fixed_table, table


def _case_sql(column: str, mapping: dict, otherwise: str) -> str:
    arms = " ".join(
        f"WHEN {sql_text(k)} THEN {sql_text(v) if isinstance(v, str) else v}" for k, v in mapping.items()
    )
    return f"CASE {column} {arms} ELSE {otherwise} END"


@query(
    "clean_date",
    r"""
    WITH raw AS (
      SELECT o_orderkey, CASE o_orderkey % 8
        WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y')
        WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') || ' - ' || strftime(o_orderdate, '%d.%m.%Y')
        WHEN 2 THEN ' ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || strftime(o_orderdate, '%y') || ' '
        WHEN 3 THEN strftime(o_orderdate, '%m.%d.%Y')
        WHEN 4 THEN 'pre ' || strftime(o_orderdate, '%d.%m.%Y')
        WHEN 5 THEN '45.45.' || year(o_orderdate)
        WHEN 6 THEN day(o_orderdate) || 'x' || strftime(o_orderdate, '%m/%Y') END AS raw
      FROM orders),
    t AS (
      SELECT *, regexp_replace(CASE WHEN regexp_matches(raw, '^\d{2}.\d{2}.\d{4}\s*-') THEN split_part(raw, '-', 1)
                               ELSE raw END, '\s', '', 'g') AS text FROM raw),
    p AS (
      SELECT *, CASE WHEN regexp_matches(text, '^\d{1,2}[./-]\d{1,2}[./-](\d{4}|\d{2})$')
                     THEN regexp_split_to_array(text, '[./-]') END AS x FROM t),
    n AS (
      SELECT *, CAST(x[1] AS INTEGER) AS a, CAST(x[2] AS INTEGER) AS b,
             CASE WHEN length(x[3]) = 4 THEN x[3] WHEN x[3] >= '76' THEN '19' || x[3] ELSE '20' || x[3] END AS y FROM p),
    d AS (
      SELECT *, TRY_CAST(CASE WHEN b > 12 AND a <= 12 THEN y || '-' || lpad(CAST(a AS VARCHAR), 2, '0') || '-' || lpad(CAST(b AS VARCHAR), 2, '0')
                     ELSE y || '-' || lpad(CAST(b AS VARCHAR), 2, '0') || '-' || lpad(CAST(a AS VARCHAR), 2, '0') END AS DATE) AS day FROM n)
    SELECT o_orderkey, raw, CASE WHEN day BETWEEN DATE '1996-01-08' AND DATE '2000-12-31' THEN day END AS day FROM d
    """,
)
def clean_date(spark, folder):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    dotted = F.date_format(day, "dd.MM.yyyy")
    raw = (
        F.when(key % 8 == 0, dotted)
        .when(key % 8 == 1, F.concat(dotted, F.lit(" - "), dotted))
        .when(key % 8 == 2, F.concat(F.lit(" "), F.date_format(day, "d.M.yy"), F.lit(" ")))
        .when(key % 8 == 3, F.date_format(day, "MM.dd.yyyy"))
        .when(key % 8 == 4, F.concat(F.lit("pre "), dotted))
        .when(key % 8 == 5, F.concat(F.lit("45.45."), F.year(day)))
        .when(key % 8 == 6, F.concat(F.dayofmonth(day), F.lit("x"), F.date_format(day, "MM/yyyy")))
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", raw.alias("raw"))
    return orders.withColumn("day", cleaning.clean_date("raw", valid_start="1996-01-08", valid_end="2000-12-31"))


_AGE_SQL = """
CASE p_partkey % 9
  WHEN 0 THEN p_size || 's' WHEN 1 THEN p_size || '-' || (p_size + 9) WHEN 2 THEN ' ' || p_size || ' '
  WHEN 3 THEN (p_size + 60) || '+' WHEN 4 THEN '-' || p_size WHEN 5 THEN p_size || '.0'
  WHEN 6 THEN 'x' || p_size || '-20' WHEN 7 THEN CAST(p_size * 3 AS VARCHAR) END
"""


def _ages(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = (
        F.when(key % 9 == 0, F.concat(size, F.lit("s")))
        .when(key % 9 == 1, F.concat(size, F.lit("-"), size + 9))
        .when(key % 9 == 2, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(key % 9 == 3, F.concat(size + 60, F.lit("+")))
        .when(key % 9 == 4, F.concat(F.lit("-"), size))
        .when(key % 9 == 5, F.concat(size, F.lit(".0")))
        .when(key % 9 == 6, F.concat(F.lit("x"), size, F.lit("-20")))
        .when(key % 9 == 7, (size * 3).cast("string"))
    )
    return table(spark, folder, "part", "p_partkey", "p_size").select("p_partkey", raw.alias("raw"))


_CLEAN_AGE_SQL = rf"""
raw AS (SELECT p_partkey, {_AGE_SQL} AS raw FROM part),
t AS (SELECT *, regexp_replace(regexp_replace(raw, '\s', '', 'g'), '\ds$', '5') AS text FROM raw),
n AS (
  SELECT *, CASE WHEN regexp_matches(text, '^\d+(-\d+)+$')
                 THEN floor(list_avg(list_transform(string_split(text, '-'), lambda v: CAST(v AS INTEGER))))
                 WHEN regexp_matches(text, '^\d+-\d+') THEN NULL
                 WHEN regexp_matches(regexp_replace(text, '[^\d.]', '', 'g'), '^\d+$')
                 THEN CAST(regexp_replace(text, '[^\d.]', '', 'g') AS BIGINT) END AS years FROM t),
ages AS (SELECT p_partkey, raw, CAST(CASE WHEN years > 0 AND years < 120 THEN years END AS INTEGER) AS age FROM n)
"""


@query("clean_age", f"WITH {_CLEAN_AGE_SQL} SELECT p_partkey, raw, age FROM ages")
def clean_age(spark, folder):
    return _ages(spark, folder).withColumn("age", cleaning.clean_age("raw"))


@query(
    "clean_float",
    r"""
    WITH raw AS (
      SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_acctbal || 'N' WHEN 1 THEN '-' || s_acctbal || ' deg'
             WHEN 2 THEN s_acctbal || '|2' WHEN 3 THEN '1-' || s_acctbal ELSE 'unknown' END AS raw FROM supplier)
    SELECT s_suppkey, TRY_CAST(regexp_replace(raw, '[^0-9|.\-]', '', 'g') AS DOUBLE) AS number FROM raw
    """,
)
def clean_float(spark, folder):
    key, value = F.col("s_suppkey"), F.col("s_acctbal")
    raw = (
        F.when(key % 5 == 0, F.concat(value, F.lit("N")))
        .when(key % 5 == 1, F.concat(F.lit("-"), value, F.lit(" deg")))
        .when(key % 5 == 2, F.concat(value, F.lit("|2")))
        .when(key % 5 == 3, F.concat(F.lit("1-"), value))
        .otherwise("unknown")
    )
    rows = table(spark, folder, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", raw.alias("raw"))
    return rows.select("s_suppkey", cleaning.clean_float("raw").alias("number"))


@query(
    "clean_bin",
    """
    SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 3 THEN 0 ELSE toxic END AS flag FROM labels
    """,
)
def clean_bin(spark, folder):
    key = F.col("doc_id")
    labels = table(spark, folder, "labels", "doc_id", "toxic")
    raw = (
        F.when(key % 5 == 4, None).when(key % 5 == 3, "yes")
        .otherwise(F.concat(F.lit(" "), F.col("toxic"), F.lit(" ")))
    )
    return labels.select("doc_id", cleaning.clean_bin(raw, missing=0).alias("flag"))


@query(
    "recode",
    f"""
    WITH raw AS (
      SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' yes ' WHEN '2-HIGH' THEN 'no'
             WHEN '3-MEDIUM' THEN 'working in another market in Wuhan' WHEN '5-LOW' THEN '18.01.2020 - 23.01.2020' END AS raw,
             CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN ' male' END AS sex FROM orders)
    SELECT o_orderkey, {_case_sql("trim(raw)", MARKET_EXPOSURE, "0")} AS exposed,
           CASE WHEN trim(raw) = 'yes' THEN 1 ELSE 0 END AS in_city,
           {_case_sql("trim(sex)", SEX_CODES, "NULL")} AS male FROM raw
    """,
)
def recode(spark, folder):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    rows = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(
        "o_orderkey",
        F.when(priority == "1-URGENT", " yes ").when(priority == "2-HIGH", "no")
        .when(priority == "3-MEDIUM", "working in another market in Wuhan")
        .when(priority == "5-LOW", "18.01.2020 - 23.01.2020").alias("raw"),
        F.when(status == "F", "female").when(status == "O", " male").alias("sex"),
    )
    return rows.select(
        "o_orderkey",
        cleaning.recode("raw", MARKET_EXPOSURE, missing=0).alias("exposed"),
        cleaning.recode("raw", {"yes": 1}, missing=0).alias("in_city"),
        cleaning.recode("sex", SEX_CODES).alias("male"),
    )


_OUTCOME_RAW = """
CASE o_orderkey % 9 WHEN 0 THEN 'Dead' WHEN 1 THEN ' died ' WHEN 2 THEN 'stable' WHEN 3 THEN 'recovered'
  WHEN 4 THEN 'discharge' WHEN 5 THEN 'DEATH' WHEN 6 THEN 'Alive' WHEN 7 THEN o_orderstatus END
"""


@query(
    "recode_outcome",
    f"""
    WITH raw AS (SELECT o_orderkey, trim({_OUTCOME_RAW}) AS raw FROM orders),
    o AS (SELECT o_orderkey, {_case_sql("raw", OUTCOME_GROUPS, "CASE WHEN raw IN ('died', 'recovered') THEN raw ELSE 'ongoing' END")} AS outcome FROM raw)
    SELECT o_orderkey, outcome, CASE WHEN outcome = 'died' THEN 1 ELSE 0 END AS died FROM o
    """,
)
def recode_outcome(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    outcome = cleaning.recode(F.expr(_OUTCOME_RAW), OUTCOME_GROUPS, missing="ongoing")
    return orders.select("o_orderkey", outcome.alias("outcome")).withColumn(
        "died", cleaning.recode("outcome", {"died": 1}, missing=0)
    )


@query(
    "rollup_name",
    f"""
    WITH c AS (
      SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' Kerala ' WHEN 1 THEN 'Odisha' WHEN 2 THEN n_name END AS country
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, CASE WHEN trim(country) IN ({sql_list(REGION_TO_COUNTRY)}) THEN 'India' ELSE trim(country) END AS country_new FROM c
    """,
)
def rollup_name(spark, folder):
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name")
    key = F.col("c_custkey")
    country = F.when(key % 4 == 0, " Kerala ").when(key % 4 == 1, "Odisha").when(key % 4 == 2, F.col("n_name"))
    rows = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return rows.select("c_custkey", cleaning.recode(country, REGION_TO_COUNTRY, keep_unmapped=True).alias("country_new"))


@query(
    "inf_to_null",
    "SELECT event_id, CASE WHEN event_id % 10 > 2 THEN value END AS value FROM events",
)
def inf_to_null(spark, folder):
    key = F.col("event_id")
    bad = F.when(key % 10 == 0, float("inf")).when(key % 10 == 1, float("-inf")).otherwise(float("nan"))
    events = table(spark, folder, "events", "event_id", "value")
    return events.select("event_id", cleaning.inf_to_null(F.when(key % 10 > 2, F.col("value")).otherwise(bad)).alias("value"))


@query("impute_constant", f"WITH {_CLEAN_AGE_SQL} SELECT p_partkey, coalesce(age, 50) AS age FROM ages")
def impute_constant(spark, folder):
    return _ages(spark, folder).select("p_partkey", cleaning.clean_age("raw").alias("age")).fillna({"age": 50})


@query(
    "impute_bernoulli",
    """
    WITH people AS (
      SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN (c_custkey * 37) % 100 < 56 THEN 1 ELSE 0 END END AS male
      FROM customer)
    SELECT c_custkey, coalesce(male, CAST(
      CAST('0x' || left(md5(c_custkey || ':0'), 8) AS BIGINT) / 4294967296.0::DOUBLE < (SELECT avg(male) FROM people) AS INTEGER)) AS male
    FROM people
    """,
)
def impute_bernoulli(spark, folder):
    key = F.col("c_custkey")
    people = table(spark, folder, "customer", "c_custkey").withColumn(
        "male", F.when(key % 3 > 0, F.when(key * 37 % 100 < 56, 1).otherwise(0)))
    return statistics.impute_by_share(people, "male", "c_custkey")


@query("mortality_rate", "SELECT round(100.0 * sum(toxic) / count(*), 6) AS rate FROM labels")
def mortality_rate(spark, folder):
    labels = table(spark, folder, "labels", "toxic")
    return labels.agg(F.round(statistics.rate("toxic"), 6).alias("rate"))


# ---------------------------------------------------------------- the whole line list


def _dated(days, shape):
    """A day as hand-entered text."""
    return F.date_format(F.date_add(F.lit("2020-01-10").cast("date"), days.cast("int")), shape)


def _raw_linelist(spark, folder):
    """Every column of a hand-entered line list, bound to the orders; written as text and read with the declared schema."""
    k = F.col("o_orderkey")
    onset, admitted, confirmed, ended = k % 60, k % 60 + k % 7, k % 60 + 3 + k % 5, k % 60 + 20 + k % 11
    pick = lambda n, *values: F.element_at(F.array(*values), (k % n + 1).cast("int"))
    text, none = F.lit, F.lit(None).cast("string")
    columns = {
        "ID": k.cast("string"),
        "age": pick(6, text("20s"), text("30-39"), text(" 45 "), text("N/A"), none, (k % 130).cast("string")),
        "sex": pick(4, text("male"), text(" female "), text("unknown"), none),
        "city": F.concat(text("city "), k % 50),
        "province": F.concat(text("prov, "), k % 20),
        "country": pick(5, text("Kerala"), text(" Delhi "), text("Germany"), none, text("France")),
        "admin1": text("a\"1"), "admin2": none, "admin3": none,
        "latitude": pick(3, text("12.5N"), text("-33.25 deg"), text("unknown")),
        "longitude": pick(2, text("100.5E"), none),
        "geo_resolution": text("point"),
        "date_onset_symptoms": pick(
            4, _dated(onset, "dd.MM.yyyy"),
            F.concat(_dated(onset, "dd.MM.yyyy"), text(" - "), _dated(onset + 2, "dd.MM.yyyy")), none, text("pre 18.01.2020")),
        "date_admission_hospital": pick(
            3, F.concat(text(" "), _dated(admitted, "d.M.yy"), text(" ")), _dated(admitted, "dd/MM/yyyy"), text("31.12.2018")),
        "date_confirmation": _dated(confirmed, "dd-MM-yyyy"),
        "date_death_or_discharge": F.when(k % 9 > 0, _dated(ended, "dd.MM.yyyy")),
        "travel_history_dates": text("18.01.2020"),
        "symptoms": text("cough, fever"), "chronic_disease": none,
        "chronic_disease_binary": pick(4, text("0"), text("1"), text("yes"), none),
        "outcome": pick(6, text("Dead"), text(" died "), text("stable"), text("Alive"), text("sick"), none),
        "lives_in_Wuhan": pick(3, text("yes"), text("no"), none),
        "reported_market_exposure": pick(4, text("yes"), text("18.01.2020 - 23.01.2020"), text("no"), none),
        "sequence_available": pick(2, text("yes"), none),
    }
    rows = table(spark, folder, "orders", "o_orderkey").select(*[value.alias(name) for name, value in columns.items()])
    return readers.read_delimited(spark, sinks.write_table(rows, scratch(spark, "linelist"), "csv"), LINELIST)


# what must come out, told from the keys and not by parsing
_LINELIST_SQL = """
keyed AS (SELECT o_orderkey AS k, DATE '2020-01-10' + CAST(o_orderkey % 60 AS INTEGER) AS d FROM orders),
dated AS (
  SELECT k, CASE WHEN k % 4 < 2 THEN d END AS date_onset_symptoms,
         CASE WHEN k % 3 < 2 THEN d + CAST(k % 7 AS INTEGER) END AS date_admission_hospital,
         d + CAST(3 + k % 5 AS INTEGER) AS date_confirmation,
         CASE WHEN k % 9 > 0 THEN d + CAST(20 + k % 11 AS INTEGER) END AS date_death_or_discharge FROM keyed),
linelist AS (
  SELECT CAST(k AS VARCHAR) AS "ID",
         CAST(CASE k % 6 WHEN 0 THEN 25 WHEN 1 THEN 34 WHEN 2 THEN 45 WHEN 5 THEN nullif(CASE WHEN k % 130 < 120 THEN k % 130 END, 0)
              END AS INTEGER) AS age,
         CASE k % 4 WHEN 0 THEN 'male' WHEN 1 THEN ' female ' WHEN 2 THEN 'unknown' END AS sex,
         'city ' || k % 50 AS city, 'prov, ' || k % 20 AS province,
         CASE k % 5 WHEN 0 THEN 'Kerala' WHEN 1 THEN ' Delhi ' WHEN 2 THEN 'Germany' WHEN 4 THEN 'France' END AS country,
         'a"1' AS admin1, CAST(NULL AS VARCHAR) AS admin2, CAST(NULL AS VARCHAR) AS admin3,
         CASE k % 3 WHEN 0 THEN 12.5::DOUBLE WHEN 1 THEN -33.25::DOUBLE END AS latitude,
         CASE WHEN k % 2 = 0 THEN 100.5::DOUBLE END AS longitude, 'point' AS geo_resolution,
         date_onset_symptoms, date_admission_hospital, date_confirmation, date_death_or_discharge,
         '18.01.2020' AS travel_history_dates, 'cough, fever' AS symptoms, CAST(NULL AS VARCHAR) AS chronic_disease,
         CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS chronic_disease_binary,
         CASE WHEN k % 6 < 2 THEN 'died' WHEN k % 6 < 4 THEN 'recovered' ELSE 'ongoing' END AS outcome,
         CAST(k % 3 = 0 AS INTEGER) AS "lives_in_Wuhan", CAST(k % 4 < 2 AS INTEGER) AS reported_market_exposure,
         CAST(k % 2 = 0 AS INTEGER) AS sequence_available,
         CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS male,
         CASE k % 5 WHEN 0 THEN 'India' WHEN 1 THEN 'India' WHEN 2 THEN 'Germany' WHEN 4 THEN 'France' END AS country_new,
         CAST(k % 6 < 2 AS INTEGER) AS died,
         date_diff('day', date_onset_symptoms, date_death_or_discharge) AS days_onset_outcome,
         date_diff('day', date_onset_symptoms, date_confirmation) AS days_onset_confirm,
         date_diff('day', date_admission_hospital, date_death_or_discharge) AS days_hosp,
         date_diff('day', date_admission_hospital, date_confirmation) AS days_admin_confirm
  FROM dated)
"""


def _cleaned(spark, folder):
    return linelist.write(linelist.clean(_raw_linelist(spark, folder)), scratch(spark, "linelist"))


@query("linelist_clean", f"WITH {_LINELIST_SQL} SELECT * FROM linelist")
def linelist_clean(spark, folder):
    return _cleaned(spark, folder)[0]


@query(
    "day_diffs",
    f"""
    WITH {_LINELIST_SQL}
    SELECT "ID", days_onset_outcome, days_onset_confirm, days_hosp, days_admin_confirm FROM linelist
    """,
)
def day_diffs(spark, folder):
    return linelist.clean(_raw_linelist(spark, folder)).select("ID", *linelist.DIFFERENCES)


_COUNTED_SQL = " UNION ALL ".join(
    f"SELECT '{column}' AS \"column\", CAST(\"{column}\" AS VARCHAR) AS value, count(*) AS n FROM linelist GROUP BY 2"
    for column in linelist.FEW_VALUES
)


@query("linelist_frequencies", f"WITH {_LINELIST_SQL} {_COUNTED_SQL}")
def linelist_frequencies(spark, folder):
    """Frequency tables of the columns of few values, observed while the rows were written."""
    metrics = _cleaned(spark, folder)[1]
    return fixed_table(spark, linelist.frequencies(metrics), "column string, value string, n bigint")


@query("linelist_complete", f"WITH {_LINELIST_SQL} SELECT * FROM linelist WHERE age IS NOT NULL AND male IS NOT NULL")
def linelist_complete(spark, folder):
    return linelist.complete(_cleaned(spark, folder)[0])


@query(
    "linelist_imputed",
    f"""
    WITH {_LINELIST_SQL}
    SELECT * REPLACE (coalesce(age, 50) AS age, coalesce(male, CAST(
      CAST('0x' || left(md5("ID" || ':0'), 8) AS BIGINT) / 4294967296.0::DOUBLE < (SELECT avg(male) FROM linelist) AS INTEGER)) AS male)
    FROM linelist
    """,
)
def linelist_imputed(spark, folder):
    return linelist.impute(*_cleaned(spark, folder))
