"""Expressions on free-text locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REGIONAL = "".join(chr(0x1F1E6 + i) for i in range(26))
_LETTERS = "".join(chr(ord("A") + i) for i in range(26))
_FLAG = r"^[\x{1F1E6}-\x{1F1FF}]{2}$"
_EDGES = r"^\s+|\s+$|\)|\("


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold_place(value) -> Column:
    """Trimmed lower case without ``.``, ``#``, ``!`` and ``@``."""
    trimmed = F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(trimmed), r"[.#!@]", "")


def is_flag(value) -> Column:
    return _col(value).rlike(_FLAG)


def flag_code(value) -> Column:
    """Two-letter code of a text that is exactly one flag; NULL otherwise."""
    text = _col(value)
    return F.when(is_flag(text), F.translate(text, _REGIONAL, _LETTERS))


def code_flag(value) -> Column:
    """Flag of an upper-case two-letter code."""
    return F.translate(_col(value), _LETTERS, _REGIONAL)


def first_part(value) -> Column:
    """City: the text before the first comma, without outer spaces and parentheses."""
    return F.regexp_replace(F.split(_col(value), ",").getItem(0), _EDGES, "")


def last_part(value) -> Column:
    """Country or state: the text after the last comma, cleaned alike."""
    return F.regexp_replace(F.element_at(F.split(_col(value), ","), -1), _EDGES, "")


def fold_for_geocoder(value) -> Column:
    """Drop ``@ # : |``, runs of slashes, and texts that are only digits."""
    return F.regexp_replace(_col(value), r"@|#|:|^[0-9]+$|\||/{2,}", "")
