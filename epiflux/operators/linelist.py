"""A patient line list, cleaned whole: dates, numbers, flags, recodes, differences and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from epiflux.functions import cleaning
from epiflux.functions.fixed_values import MARKET_EXPOSURE, OUTCOME_GROUPS, REGION_TO_COUNTRY, SEX_CODES
from epiflux.operators.statistics import fill_by_share
from epiflux.sources import sinks

DATES = ("date_onset_symptoms", "date_admission_hospital", "date_confirmation", "date_death_or_discharge")

#: Days from the first date to the second.
DIFFERENCES = {
    "days_onset_outcome": ("date_onset_symptoms", "date_death_or_discharge"),
    "days_onset_confirm": ("date_onset_symptoms", "date_confirmation"),
    "days_hosp": ("date_admission_hospital", "date_death_or_discharge"),
    "days_admin_confirm": ("date_admission_hospital", "date_confirmation"),
}

#: Columns of few values, and those values.
FEW_VALUES = {
    "chronic_disease_binary": (0, 1), "lives_in_Wuhan": (0, 1), "reported_market_exposure": (0, 1),
    "sequence_available": (0, 1), "outcome": ("died", "recovered", "ongoing"), "died": (0, 1), "male": (0, 1),
}


def clean(raw: DataFrame, first_date: str = "2019-08-01", last_date: str | None = None) -> DataFrame:
    """The declared line list with every column cleaned, and what is derived from it.

    Rows are cleaned where they are read.  Dates outside ``first_date`` to ``last_date``
    (today) are missing.  Columns that are only text stay as they are.  New are ``died``,
    ``male``, ``country_new`` and the four differences of ``DIFFERENCES``.
    """
    recode = cleaning.recode
    cleaned = raw.withColumns({
        **{name: cleaning.clean_date(name, first_date, last_date) for name in DATES},
        "age": cleaning.clean_age("age"),
        "latitude": cleaning.inf_to_null(cleaning.clean_float("latitude")),
        "longitude": cleaning.inf_to_null(cleaning.clean_float("longitude")),
        "chronic_disease_binary": cleaning.clean_bin("chronic_disease_binary", missing=0),
        "lives_in_Wuhan": recode("lives_in_Wuhan", {"yes": 1}, missing=0),
        "sequence_available": recode("sequence_available", {"yes": 1}, missing=0),
        "reported_market_exposure": recode("reported_market_exposure", MARKET_EXPOSURE, missing=0),
        "outcome": recode("outcome", OUTCOME_GROUPS, missing="ongoing"),
        "male": recode("sex", SEX_CODES),
        "country_new": recode("country", REGION_TO_COUNTRY, keep_unmapped=True),
    })
    return cleaned.withColumns({
        "died": recode("outcome", {"died": 1}, missing=0),
        **{name: F.date_diff(F.col(end), F.col(start)) for name, (start, end) in DIFFERENCES.items()},
    })


def _metrics() -> dict:
    """Aggregates that are observed while rows pass: the frequencies of columns of few values, and means."""
    found = {"rows": F.count(F.lit(1)), "ages": F.count("age"), "male_share": F.avg("male")}
    for column, values in FEW_VALUES.items():
        for value in values:
            found[f"{column}={value}"] = F.count_if(F.col(column) == value)
        found[f"{column}="] = F.count_if(F.col(column).isNull())
    return found


def write(cleaned: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """Write cleaned rows as parquet, and return them with the metrics observed on the way: one scan of the input."""
    observed = Observation("linelist")
    passing = cleaned.observe(observed, *[value.alias(name) for name, value in _metrics().items()])
    sinks.write_table(passing, path)
    return cleaned.sparkSession.read.schema(cleaned.schema).parquet(path), observed.get


def frequencies(metrics: dict) -> list[tuple[str, str | None, int]]:
    """``(column, value, n)`` of the observed columns of few values; values that do not occur are left out."""
    rows = []
    for name, n in metrics.items():
        column, sign, value = name.partition("=")
        if sign and n:
            rows.append((column, value or None, n))
    return rows


def complete(cleaned: DataFrame) -> DataFrame:
    """Rows with an age and a sex."""
    return cleaned.filter(F.col("age").isNotNull() & F.col("male").isNotNull())


def impute(cleaned: DataFrame, metrics: dict, age: int = 50) -> DataFrame:
    """Missing ages set to ``age``; missing sexes drawn by the observed share."""
    return fill_by_share(cleaned.fillna({"age": age}), "male", "ID", F.lit(metrics["male_share"]))
