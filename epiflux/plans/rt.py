"""Reproduction number; event types stand in for counties, their daily counts for cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiflux.operators import rt, series
from epiflux.plans.bindings import cases
from epiflux.plans.daily import SMOOTH_SQL
from epiflux.plans.registry import query
from epiflux.session import stored

_STEP, _N = 0.01, 501
_SIGMA = 0.15

_LIKE_SQL = f"""
{SMOOTH_SQL},
days AS (
  SELECT county, date, smoothed, row_number() OVER w AS d, lag(smoothed) OVER w AS before
  FROM prepared WINDOW w AS (PARTITION BY county ORDER BY date)),
grid AS (SELECT i, i * {5.0 / (_N - 1)} AS r FROM range({_N}) AS t(i)),
likes AS (
  SELECT county, date, d, i, exp(smoothed * ln(before * exp((r - 1) / 7)) - before * exp((r - 1) / 7) - lgamma(smoothed + 1)) AS likelihood
  FROM days, grid WHERE before IS NOT NULL)
"""


def _filter_sql(sigmas: str) -> str:
    return f"""
    WITH RECURSIVE {_LIKE_SQL},
    listed AS (SELECT county, d, list(likelihood ORDER BY i) AS l FROM likes GROUP BY county, d),
    sigmas AS (SELECT unnest({sigmas}) AS sigma),
    raw AS (
      SELECT sigma, a.i AS i, b.i AS j, exp(-0.5 * pow((a.r - b.r) / sigma, 2)) AS w FROM grid a, grid b, sigmas),
    kernel AS (SELECT sigma, i, list(p ORDER BY j) AS row FROM (
      SELECT sigma, i, j, w / sum(w) OVER (PARTITION BY sigma, j) AS p FROM raw) GROUP BY sigma, i),
    kernels AS (SELECT sigma, list(row ORDER BY i) AS k FROM kernel GROUP BY sigma),
    rec AS (
      SELECT county, sigma, CAST(1 AS BIGINT) AS d, list_transform(range({_N}), lambda x: CAST(1.0 / {_N} AS DOUBLE)) AS post,
             CAST(0 AS DOUBLE) AS ll FROM (SELECT DISTINCT county FROM days), sigmas
      UNION ALL
      SELECT county, sigma, d, list_transform(num, lambda x: x / list_sum(num)), ll + ln(list_sum(num)) FROM (
        SELECT rec.county, rec.sigma, listed.d, rec.ll,
               list_transform(k, lambda row, i: l[i] * list_inner_product(row, post)) AS num
        FROM rec JOIN listed ON rec.county = listed.county AND listed.d = rec.d + 1 JOIN kernels ON kernels.sigma = rec.sigma))
    """


def _prepared(spark, folder):
    return series.prepare_cases(cases(spark, folder), "county", "date", "confirmed", cutoff=5)


@query(
    "rt_likelihood",
    f"WITH {_LIKE_SQL} SELECT county, date, CAST(i AS INTEGER) AS step, round(likelihood, 7) AS likelihood FROM likes",
)
def rt_likelihood(spark, folder):
    rows = rt.likelihoods(_prepared(spark, folder), "county", "date", "smoothed", _STEP)
    return rows.withColumn("likelihood", F.round("likelihood", 7))


@query(
    "rt_posterior",
    f"""
    {_filter_sql(f"[{_SIGMA}]")}
    SELECT county, date, CAST(i AS INTEGER) AS step, round(post[i + 1], 7) AS posterior
    FROM rec JOIN days USING (county, d), grid
    """,
)
def rt_posterior(spark, folder):
    rows = rt.posteriors(_prepared(spark, folder), "county", "date", "smoothed", _SIGMA, _STEP)
    return rows.withColumn("posterior", F.round("posterior", 7))


@query("rt_sigma")
def rt_sigma(spark, folder):
    """Twenty sigmas on 501 values are too slow in SQL; a test follows them by brute force."""
    logliks = rt.sigma_likelihoods(_prepared(spark, folder), "county", "date", "smoothed", step=_STEP)
    totals = stored(rt.sigma_totals(logliks, "county"), "rt-totals")
    chosen = F.col("sigma") == rt.best_sigma(totals).scalar()
    return totals.select(
        F.round("sigma", 2).alias("sigma"), F.round("total", 5).alias("total"), chosen.alias("chosen")
    )


def _most_likely(spark, folder, step):
    prepared = stored(_prepared(spark, folder), "rt-cases")
    totals = rt.sigma_totals(rt.sigma_likelihoods(prepared, "county", "date", "smoothed", step=step), "county")
    return rt.most_likely(prepared, "county", "date", "smoothed", rt.best_sigma(totals), step)


@query("rt_most_likely")
def rt_most_likely(spark, folder):
    return _most_likely(spark, folder, _STEP).withColumn("ml", F.round("ml", 6))


@query(
    "rt_split_key",
    f"""
    WITH {SMOOTH_SQL}
    SELECT county AS state_county, date, split_part(county, '-', 1) AS state, split_part(county, '-', 2) AS county FROM prepared
    """,
)
def rt_split_key(spark, folder):
    rows = _prepared(spark, folder).select(F.col("county").alias("state_county"), "date")
    return rt.split_county(rows, "state_county")
