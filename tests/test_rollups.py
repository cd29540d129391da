"""Stored rollups: whatever periods and keys are merged, counts are exact and sketches within their bounds."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import rollups
from gaugework.operators.rollups import Rollup

ROLLUP = Rollup(
    "at", keys=("k",), counts={"valued": "v"}, sums={"total": "v"}, distinct={"users": "u"}, values={"value": "v"}, lg_k=12, k=400
)


def log(spark, first, days, n=200):
    rows = spark.range(days * n).select(
        (F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % (days * 24)).cast("int"))).alias("at"),
        F.when(F.col("id") % 3 != 0, F.lit("hot")).alias("k"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 1013).cast("double")).alias("v"),
        F.concat(F.lit("u"), F.col("id") % 501).alias("u"),
    )
    return rows


def test_any_period_comes_from_stored_days(spark, tmp_path):
    rows, path = log(spark, "2024-01-10", 60).cache(), str(tmp_path / "r")
    ROLLUP.write(rows, path)
    for start, end in (("2024-01-10", "2024-03-31"), ("2024-01-20", "2024-02-03"), ("2024-02-29", "2024-02-29")):
        last = f"{end} 23:59:59"
        got = ROLLUP.answer(ROLLUP.read(spark, path, start, last), {"p50": ("value", 0.5), "p99": ("value", 0.99)}).first()
        own = rows.where(f"at between timestamp_ntz'{start}' and timestamp_ntz'{last}'").toPandas()
        assert (got.rows, got.valued, got.total) == (len(own), own.v.count(), own.v.sum())
        assert got.users == pytest.approx(own.u.nunique(), rel=4 * rollups.distinct_error(12))
        values = own.v.dropna().to_numpy()
        for p, q in ((0.5, got.p50), (0.99, got.p99)):
            assert np.mean(values < q) - rollups.rank_error(400) <= p <= np.mean(values <= q) + rollups.rank_error(400)
    by = {r.k: r for r in ROLLUP.answer(ROLLUP.read(spark, path, "2024-01-01", "2024-12-31"), by=["k"]).collect()}
    assert {k: r.rows for k, r in by.items()} == {r.k: r["count"] for r in rows.groupBy("k").count().collect()}


def test_a_month_is_replaced_whole_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "r")
    ROLLUP.write(log(spark, "2024-01-01", 60), path)
    ROLLUP.write(log(spark, "2024-02-01", 10, n=24), path)
    got = {r.month: r.n for r in ROLLUP.read(spark, path, "2024-01-01", "2024-12-31").groupBy(F.month("period").alias("month")).agg(F.sum("rows").alias("n")).collect()}
    assert got == {1: log(spark, "2024-01-01", 60).where("at < timestamp_ntz'2024-02-01'").count(), 2: 240}
    plan = ROLLUP.read(spark, path, dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 28))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan


def test_nothing_stored_for_a_period(spark, tmp_path):
    path = str(tmp_path / "r")
    ROLLUP.write(log(spark, "2024-01-01", 5), path)
    got = ROLLUP.answer(ROLLUP.read(spark, path, "2025-01-01", "2025-01-31"), {"p50": ("value", 0.5)}).first()
    assert tuple(got) == (0, 0, None, 0, None)
