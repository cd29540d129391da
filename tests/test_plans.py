"""What the plans look like: pushed filters, pruned columns, no Python, no cross joins."""

import re

import pytest

from checks import QUERIES
from tests.conftest import SF_DIR

# Queries that write or stream build their result from what they wrote.
ACTS = re.compile(r"^(load_|stream_|write_|versioned_|usage_log_|incremental_)")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not ACTS.match(n)))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for bad in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert bad not in plan


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("credits_by_hour", "ts"),
        ("warehouse_quota_status", "ts"),
        ("perf_summary", "ts"),
        ("failed_logins", "ts"),
        ("credits_month_over_month", "l_shipdate"),
        ("task_runs", "o_orderdate"),
        ("load_history", "o_orderdate"),
    ],
)
def test_time_bounds_reach_the_scan(spark, name, column):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert re.search(rf"PushedFilters: \[[^\]]*(GreaterThanOrEqual|GreaterThan)\({column}", plan)


def test_only_the_columns_in_use_are_read(spark):
    plan = plan_of(QUERIES["credits_by_hour"](spark, SF_DIR))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["event_type", "ts", "value"]


def test_top_k_does_not_sort_everything(spark):
    plan = plan_of(QUERIES["slowest_queries"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan
    assert "Exchange rangepartitioning" not in plan


def test_usage_is_aggregated_before_the_quota_join(spark):
    plan = plan_of(QUERIES["warehouse_quota_status"](spark, SF_DIR))
    join = plan.index("Join")
    assert "partial_sum(credits_used" in plan[join:] or "partial_sum(value" in plan[join:]


@pytest.mark.parametrize("name", ["user_share_by_warehouse", "user_warehouse_matrix", "perf_by_day", "perf_summary"])
def test_the_log_is_read_and_shuffled_once(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
    assert "ReusedExchange" in final


def test_foreign_dimensions_join_aggregated_facts(spark):
    plan = plan_of(QUERIES["metrics_by_user_role"](spark, SF_DIR))
    # Below the joins every scan of the log already ends in a partial aggregation.
    assert "partial_count" in plan
    below = plan[plan.rindex("Join") :]
    assert "HashAggregate" in below or "SortAggregate" in below


def test_hot_keys_of_a_shuffle_join_are_split(spark):
    from pyspark.sql import functions as F

    from gaugework.operators import landing

    settings = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        hot = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
        versions = spark.range(0, n, 1, 8).select(
            hot.alias("k"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("_loaded_at"),
            F.lpad(F.col("id").cast("string"), 10, "0").alias("_source_file"),
            F.sha2(F.col("id").cast("string"), 256).alias("_row_hash"),
            F.lit(True).alias("_is_current"),
        )
        marked = landing.mark_current(versions, ["k"], distinct_rows=True)
        counted = marked.groupBy("_is_current").count()
        got = {r._is_current: r["count"] for r in counted.collect()}
        assert got == {True: n - n // 3 + 1, False: n // 3 - 1}
        assert "skew" in plan_of(counted).split("== Initial Plan ==")[0].lower()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["security_metrics", "metrics_by_user_role", "login_metrics_by_client"])
def test_distinct_counts_do_not_multiply_the_log(spark, name):
    assert "Expand" not in plan_of(QUERIES[name](spark, SF_DIR))
