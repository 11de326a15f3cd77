"""Compare the queries with their SQL on one folder of test tables.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections.abc import Iterable

import duckdb

from checks.catalog import QUERIES
from checks.oracle import ORACLE
from marketlens.session import build_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _key(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(float(value)))
    return (3, str(value))


def normalized(columns: list[str], rows: Iterable[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def differences(spark, con, sf_dir: str, name: str) -> str:
    """Empty when both sides agree."""
    got = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    want = con.execute(ORACLE[name])
    want_columns = [d[0] for d in want.description]
    want_rows = want.fetchall()
    if sorted(got.columns) != sorted(want_columns):
        return f"columns {sorted(got.columns)} != {sorted(want_columns)}"
    if len(rows) != len(want_rows):
        return f"{len(rows)} rows, expected {len(want_rows)}"
    mine, theirs = normalized(got.columns, rows), normalized(want_columns, want_rows)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(rows)} rows differ, first:\n  {wrong[0][0]}\n  {wrong[0][1]}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.perf_counter()
        try:
            problem = differences(spark, con, sf_dir, name) if name in ORACLE else ""
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.perf_counter() - start:.2f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
