"""Cleaning expressions for hand-entered records: dates, ages, numbers, flags, recodes.

Everything is a Column expression, so a whole line list is cleaned in one
projection inside code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE_SHAPE = r"^\d{1,2}.\d{1,2}.\d{2,4}"
_DATE_SHAPE_FULL = r"^\d{1,2}[./-]\d{1,2}[./-](\d{4}|\d{2})$"


def _strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_date(value, valid_start=None, valid_end=None, missing=None, two_digit_pivot=76) -> Column:
    """Day-first date of a messy text, or NULL.

    A range keeps its first date.  Month and day are swapped only when the
    day-first reading is impossible.  Two-digit years from ``two_digit_pivot`` on
    are read as 19xx.  ``valid_end`` defaults to today when a start is given.
    """
    text = F.col(value).cast("string") if isinstance(value, str) else value.cast("string")
    text = F.when(
        text.rlike(r"^\d{2}.\d{2}.\d{4}\s*-"), F.split(text, "-").getItem(0)
    ).otherwise(text)
    text = _strip_spaces(text)
    if missing is not None:
        text = F.when(~text.rlike(_DATE_SHAPE), F.lit(missing)).otherwise(text)

    end = F.current_date() if valid_end is None else F.lit(valid_end).cast("date")

    def to_day(parts: Column) -> Column:
        first, second = (F.lpad(F.get(parts, F.lit(i)), 2, "0") for i in (0, 1))
        year = F.get(parts, F.lit(2))
        year = (
            F.when(F.length(year) == 4, year)
            .when(year >= F.lit(f"{two_digit_pivot:02d}"), F.concat(F.lit("19"), year))
            .otherwise(F.concat(F.lit("20"), year))
        )
        swap = (second > "12") & (first <= "12")
        iso = F.concat_ws(
            "-", year, F.when(swap, first).otherwise(second), F.when(swap, second).otherwise(first)
        )
        return iso.try_cast("date")

    parts = F.when(text.rlike(_DATE_SHAPE_FULL), F.split(text, "[./-]"))
    day = _named(parts, to_day)
    if valid_start is None:
        return day
    return _named(day, lambda d: F.when(d.between(F.lit(valid_start).cast("date"), end), d))


def clean_age(value) -> Column:
    """Whole years in 1..119: ``20s`` is 25, ``30-39`` its rounded-down mean, else digits only."""
    text = F.col(value).cast("string") if isinstance(value, str) else value.cast("string")
    text = F.regexp_replace(_strip_spaces(text), r"\ds$", "5")
    pieces = F.transform(F.split(text, "-"), lambda piece: piece.try_cast("bigint"))
    total = F.aggregate(pieces, F.lit(0).cast("bigint"), lambda acc, piece: acc + piece)
    midpoint = F.floor(total / F.size(pieces))
    digits = F.regexp_replace(text, r"[^\d.]", "")
    years = (
        F.when(text.rlike(r"^\d+(-\d+)+$"), midpoint)
        .when(text.rlike(r"^\d+-\d+"), F.lit(None))
        .when(digits.rlike(r"^\d+$"), digits.try_cast("bigint"))
    )
    return F.when((years > 0) & (years < 120), years).cast("int")


def clean_float(value) -> Column:
    """Number left after dropping everything but digits, ``.``, ``-`` and ``|``; NULL if it does not parse."""
    text = F.col(value).cast("string") if isinstance(value, str) else value.cast("string")
    return F.regexp_replace(text, r"[^\d|.\-]", "").try_cast("double")


def clean_bin(value, missing: int | None = None, numeric: bool = False) -> Column:
    """0/1 of a text flag; any other text becomes ``missing``, NULL stays NULL.

    A ``numeric`` column is only cut to whole numbers.
    """
    text = F.col(value) if isinstance(value, str) else value
    if numeric:
        return int_or_null(inf_to_null(text))
    text = _strip_spaces(text.cast("string"))
    return (
        F.when(text.isNull(), F.lit(None))
        .when(text.isin("0", "1"), text.try_cast("int"))
        .otherwise(F.lit(missing))
        .cast("int")
    )


def recode(value, mapping: Mapping, missing=None, keep_unmapped: bool = False) -> Column:
    """Trimmed text looked up in ``mapping``.

    Unmapped text becomes ``missing`` unless it already equals one of the targets,
    or is kept as it is with ``keep_unmapped``.
    """
    text = F.trim(F.col(value) if isinstance(value, str) else value)
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    mapped = F.try_element_at(F.create_map(*pairs), text)
    if keep_unmapped:
        return F.coalesce(mapped, text)
    targets = sorted({target for target in mapping.values() if isinstance(target, str)})
    if targets:
        mapped = F.coalesce(mapped, F.when(text.isin(targets), text))
    return mapped if missing is None else F.coalesce(mapped, F.lit(missing))


def inf_to_null(value) -> Column:
    """Infinite and NaN doubles count as missing."""
    number = F.col(value) if isinstance(value, str) else value
    return F.when(~(F.isnan(number) | (F.abs(number) == F.lit(float("inf")))), number)


def int_or_null(value) -> Column:
    """Whole number of a value, fractions cut off; NULL where it does not parse."""
    number = F.col(value) if isinstance(value, str) else value
    return number.try_cast("int")
