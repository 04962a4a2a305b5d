"""Run registered queries next to their SQL and compare the results.

    python tests/compare.py [-sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tablegate.session import local_session  # noqa: E402
from workload.inputs import TABLES  # noqa: E402

import workload  # noqa: E402

DEFAULT_SF = "/root/testdata/sf0.01"


def connect(sf: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def normal(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def compare(spark, connection, sf, name):
    start = time.time()
    columns, got = spark_rows(workload.QUERIES[name](spark, sf))
    spark_time = time.time() - start
    if name not in workload.ORACLES:
        return "rows-only", len(got), spark_time, 0.0, ""
    start = time.time()
    want_columns, want = duck_rows(connection, workload.ORACLES[name])
    duck_time = time.time() - start
    if columns != want_columns:
        return "COLUMNS", len(got), spark_time, duck_time, f"{columns} / {want_columns}"
    if got != want:
        a, b = set(got), set(want)
        detail = (f"{len(got)} rows, sql {len(want)}\n   only spark: {sorted(a - b)[:4]}"
                  f"\n   only sql:   {sorted(b - a)[:4]}")
        return "DIFFERENT", len(got), spark_time, duck_time, detail
    return "ok" if got else "EMPTY", len(got), spark_time, duck_time, ""


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("-sf", default=DEFAULT_SF)
    parser.add_argument("queries", nargs="*")
    args = parser.parse_args()
    workload.load()
    chosen = args.queries or list(workload.QUERIES)
    spark, connection = local_session(8), connect(args.sf)
    bad = 0
    for name in chosen:
        try:
            status, count, spark_time, duck_time, detail = compare(spark, connection, args.sf, name)
        except Exception as error:  # noqa: BLE001
            text = str(error)
            status, count, spark_time, duck_time, detail = "ERROR", 0, 0, 0, text[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:24} {count:8} rows  spark {spark_time:6.2f}s  sql {duck_time:6.2f}s  {detail}",
              flush=True)
    print(f"{len(chosen)} queries, {bad} not ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
