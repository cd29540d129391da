"""Run queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks import ORACLES, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    """Values compared by type and content: 1 and 1.0 or a date and a timestamp differ."""
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (bool, int, str, bytes, dt.date, decimal.Decimal)) or value is None:
        return value
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(repr(tuple(_plain(row[i]) for i in order)) for row in rows)


def difference(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[str | None, int]:
    """What differs between the query and its SQL (None when equal) and the row count."""
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return None, len(got)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", len(got)
    a, b = _rows(df.columns, got), _rows(columns, want)
    if a != b:
        return (
            f"rows {len(got)} vs {len(want)}; only here {list((a - b).keys())[:2]}; "
            f"only in SQL {list((b - a).keys())[:2]}"
        ), len(got)
    return None, len(got)


def main(argv: list[str]) -> int:
    from gaugework.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            diff, n = difference(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += diff is not None
        mark = "FAIL" if diff else ("ok  " if name in ORACLES else "rows")
        print(f"{mark} {name:40s} {n:7d} rows {time.time() - began:6.2f}s {diff or ''}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
