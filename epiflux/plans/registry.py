"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its oracle."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def with_utc(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, folder)

        QUERIES[name] = with_utc
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_rows(rows) -> str:
    """Rows for a VALUES clause."""
    def cell(value):
        if value is None:
            return "NULL"
        return sql_text(value) if isinstance(value, str) else str(value)

    return ", ".join("(" + ", ".join(cell(value) for value in row) + ")" for row in rows)


def sql_list(values) -> str:
    return ", ".join(sql_text(value) for value in values)
