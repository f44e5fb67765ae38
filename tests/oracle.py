"""Compare registered queries with their SQL; ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [plain(v) for v in value]
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def kind(value):
    return {int: "int", float: "float"}.get(type(value), type(value).__name__)


def oracle_rows(folder: str, sql: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return names, [dict(zip(names, row)) for row in result.fetchall()]


def compare(spark, folder: str, name: str, run, sql: str | None):
    """A message per difference; an empty list means equal."""
    frame = run(spark, folder)
    got = [row.asDict() for row in frame.collect()]
    if sql is None:
        return len(got), []
    names, want = oracle_rows(folder, sql)
    problems = []
    if sorted(frame.columns) != sorted(names):
        return len(got), [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    order = sorted(names)
    left = sorted(repr([plain(row[c]) for c in order]) for row in got)
    right = sorted(repr([plain(row[c]) for c in order]) for row in want)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        only_left = sorted(set(left) - set(right))[:3]
        only_right = sorted(set(right) - set(left))[:3]
        problems.append(f"{order}\n   spark {only_left}\n   sql   {only_right}")
    return len(got), problems


def main(arguments: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry_module
    from epiflux.session import build_session

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    wanted = arguments[1:]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    oracles = entry_module.oracle_sql()
    for name, run in entry_module.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            rows, problems = compare(spark, folder, name, run, oracles.get(name))
        except Exception as error:  # report and go on with the other queries
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:700]}"]
        state = "FAIL" if problems else ("ok" if name in oracles else "rows")
        failed += bool(problems)
        print(f"{state:5}{name:26}{rows:8} rows {time.time() - began:6.2f} s", flush=True)
        for problem in problems:
            print("     ", problem[:1500], flush=True)
    print("failed", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
