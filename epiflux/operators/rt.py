"""Effective reproduction number per key and day by a Bayesian forward filter on a grid.

The filter is sequential over days and independent over keys and sigmas, so it
runs as one grouped map per (key, sigma); a group is one key's days, already
aggregated, however many raw rows a key has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAMMA = 1 / 7  # fixed value: one over the serial interval in days
R_MAX = 5.0
SIGMAS = [float(s) for s in np.linspace(1 / 20, 1, 20)]


def grid(step: float = 0.01, r_max: float = R_MAX) -> np.ndarray:
    return np.linspace(0, r_max, int(round(r_max / step)) + 1)


def log_factorial(k: Column) -> Column:
    """``ln(k!)`` by Stirling's series, shifted by ten so small ``k`` are exact to 1e-12."""
    z = k + 11.0
    series = (
        (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
        + 1 / (12.0 * z) - 1 / (360.0 * F.pow(z, 3)) + 1 / (1260.0 * F.pow(z, 5))
    )
    product = F.lit(0.0)
    for i in range(1, 11):
        product = product + F.log(k + float(i))
    return series - product


def likelihoods(df: DataFrame, key: str, date: str, cases: str, step: float = 0.01) -> DataFrame:
    """Poisson likelihood of each day's cases for every grid value, from the second day on."""
    by_day = Window.partitionBy(key).orderBy(date)
    steps = len(grid(step)) - 1
    rows = df.withColumn("_before", F.lag(cases).over(by_day)).filter(F.col("_before").isNotNull())
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    r = F.col("step") * F.lit(R_MAX / steps)
    lam = F.col("_before") * F.exp(F.lit(GAMMA) * (r - 1.0))
    k = F.col(cases)
    value = (
        F.when((lam > 0) & (k >= 0), F.exp(k * F.log(lam) - lam - log_factorial(k)))
        .when((lam == 0) & (k == 0), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return rows.select(key, date, "step", value.alias("likelihood"))


_KERNELS: dict = {}


def _kernel(r: np.ndarray, sigma: float) -> np.ndarray:
    """Transition weights; columns sum to one.  Kept per task for the sigmas it meets."""
    name = (len(r), sigma)
    if name not in _KERNELS:
        weights = np.exp(-0.5 * ((r[:, None] - r[None, :]) / sigma) ** 2)
        _KERNELS[name] = weights / weights.sum(axis=0)
    return _KERNELS[name]


def forward_filter(cases: np.ndarray, sigma: float, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Posterior per day (rows) over the grid, and the log-likelihood of the series.

    Each day's likelihood is scaled by its maximum, which is added back in logs, so
    large counts do not underflow.
    """
    kernel = _kernel(r, sigma)
    posterior = np.full((len(cases), len(r)), np.nan)
    posterior[0] = 1.0 / len(r)
    total = 0.0
    growth = np.exp(GAMMA * (r - 1))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for day in range(1, len(cases)):
            k, lam = cases[day], cases[day - 1] * growth
            if k < 0 or cases[day - 1] < 0:
                return posterior, float("nan")
            logs = np.where(lam > 0, k * np.log(lam), 0.0 if k == 0 else -np.inf) - lam - math.lgamma(k + 1)
            top = logs.max()
            if not np.isfinite(top):
                return posterior, float("nan")
            joint = np.exp(logs - top) * (kernel @ posterior[day - 1])
            mass = joint.sum()
            posterior[day] = joint / mass
            total += math.log(mass) + top if mass > 0 else float("-inf")
    return posterior, total


def posteriors(df: DataFrame, key: str, date: str, cases: str, sigma: float, step: float = 0.01) -> DataFrame:
    """``(key, date, step, posterior)`` for one sigma."""
    r = grid(step)

    def run(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values(date)
        posterior, _ = forward_filter(days[cases].to_numpy(dtype=float), sigma, r)
        count = len(days)
        return pd.DataFrame(
            {
                key: np.repeat(days[key].to_numpy(), len(r)),
                date: np.repeat(days[date].to_numpy(), len(r)),
                "step": np.tile(np.arange(len(r)), count),
                "posterior": posterior.ravel(),
            }
        )

    kinds = dict(df.dtypes)
    return df.select(key, date, cases).groupBy(key).applyInPandas(
        run, f"`{key}` {kinds[key]}, `{date}` {kinds[date]}, step int, posterior double"
    )


def sigma_likelihoods(
    df: DataFrame, key: str, date: str, cases: str, sigmas: list[float] = SIGMAS, step: float = 0.01
) -> DataFrame:
    """``(key, sigma, loglik)``; a group returns one number, never its posterior."""
    r = grid(step)

    def run(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values(date)
        sigma = float(days["sigma"].iloc[0])
        _, total = forward_filter(days[cases].to_numpy(dtype=float), sigma, r)
        return pd.DataFrame({key: [days[key].iloc[0]], "sigma": [sigma], "loglik": [total]})

    choices = F.array(*[F.lit(s) for s in sigmas])
    kind = dict(df.dtypes)[key]
    return df.select(key, date, cases, F.explode(choices).alias("sigma")).groupBy(key, "sigma").applyInPandas(
        run, f"`{key}` {kind}, sigma double, loglik double"
    )


def sigma_totals(logliks: DataFrame, key: str) -> DataFrame:
    """``(sigma, total)`` over the keys whose log-likelihood is finite for every sigma."""
    finite = F.coalesce(F.abs("loglik") < float("inf"), F.lit(False)) & ~F.isnan("loglik")
    bad = logliks.filter(~finite).select(key).distinct()
    return logliks.join(bad, key, "left_anti").groupBy("sigma").agg(F.sum("loglik").alias("total"))


def best_sigma(totals: DataFrame) -> DataFrame:
    """One row: the sigma with the highest total, the smallest of equals."""
    return totals.agg(F.min_by("sigma", F.struct((-F.col("total")).alias("loss"), "sigma")).alias("sigma"))


def most_likely(df: DataFrame, key: str, date: str, cases: str, sigma: DataFrame, step: float = 0.01) -> DataFrame:
    """``(key, date, ml)``: grid value of the posterior's first maximum, for the chosen sigma.

    ``sigma`` is a one-cell frame, read as a scalar subquery.
    """
    r = grid(step)

    def run(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values(date)
        posterior, _ = forward_filter(
            days[cases].to_numpy(dtype=float), float(days["sigma"].iloc[0]), r
        )
        known = ~np.isnan(posterior).any(axis=1)
        at = np.where(known, np.nan_to_num(posterior, nan=-1.0).argmax(axis=1), 0)
        return pd.DataFrame(
            {key: days[key].to_numpy(), date: days[date].to_numpy(), "ml": np.where(known, r[at], np.nan)}
        )

    kinds = dict(df.dtypes)
    rows = df.select(key, date, cases).withColumn("sigma", sigma.scalar())
    out = rows.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{date}` {kinds[date]}, ml double")
    return out.withColumn("ml", F.nanvl("ml", F.lit(None).cast("double")))


def split_county(df: DataFrame, key: str) -> DataFrame:
    """Add ``state`` and ``county``: the first two parts of ``state-county``."""
    parts = F.split(F.col(key), "-")
    return df.withColumns({"state": parts.getItem(0), "county": F.get(parts, F.lit(1))})
