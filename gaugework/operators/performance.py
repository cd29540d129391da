"""Query performance, activity and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import (
    asc,
    desc,
    exact_percentiles,
    month_start,
    ntz,
    ordered,
    round_to,
    seconds_between,
    top_k,
    trunc_to,
    value_counts,
)
from gaugework.operators.filters import lookback, period_filter, preview_text, since
from gaugework.operators.reshape import unpivot
from gaugework.operators.storage import GIB

# Slow-query limit in ms; day labels, 0 = Sunday.
SLOW_QUERY_MS = 60_000
DAY_LABELS = {0: "Dim", 1: "Lun", 2: "Mar", 3: "Mer", 4: "Jeu", 5: "Ven", 6: "Sam"}

MIB = 1024.0**2


def _seconds(col: str, digits: int) -> Column:
    return round_to(F.col(col) / 1000, digits)


def _avg_seconds(digits: int) -> Column:
    return round_to(F.avg("total_elapsed_time") / 1000, digits)


def _gb(expr: Column) -> Column:
    return round_to(expr / F.lit(GIB), 2)


def _errors() -> Column:
    return F.count_if(F.col("error_code").isNotNull())


def query_count(qh: DataFrame, start, end) -> DataFrame:
    return period_filter(qh, "start_time", start, end).agg(F.count(F.lit(1)).alias("total"))


def query_volume_24h(qh: DataFrame, as_of) -> DataFrame:
    return lookback(qh, "start_time", 1, "day", as_of).agg(
        F.count(F.lit(1)).alias("total"), _errors().alias("errors")
    )


def active_users_month(qh: DataFrame, as_of, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.countDistinct
    return since(qh, "start_time", month_start(as_of), as_of).agg(count("user_name").alias("cnt"))


def perf_summary(qh: DataFrame, start, end, approx: bool = False) -> DataFrame:
    """Totals, average, exact median and p95 (seconds) and the number of slow queries."""
    rows = period_filter(qh, "start_time", start, end).select("total_elapsed_time")
    if approx:
        p = F.percentile_approx("total_elapsed_time", [0.5, 0.95], 10_000)
        return rows.agg(
            F.count(F.lit(1)).alias("total_queries"),
            _avg_seconds(2).alias("avg_duration_sec"),
            round_to(p[0] / 1000, 2).alias("median_duration_sec"),
            round_to(p[1] / 1000, 2).alias("p95_duration_sec"),
            F.count_if(F.col("total_elapsed_time") > SLOW_QUERY_MS).alias("slow_queries"),
        )
    counts = value_counts(rows, [], "total_elapsed_time")
    sums = {**_average(), "slow": F.when(F.col("total_elapsed_time") > SLOW_QUERY_MS, F.col("freq"))}
    row = exact_percentiles(counts, [], "total_elapsed_time", {"p50": 0.5, "p95": 0.95}, sums)
    return row.select(
        F.coalesce("rows", F.lit(0)).alias("total_queries"),
        round_to(_mean() / 1000, 2).alias("avg_duration_sec"),
        round_to(F.col("p50") / 1000, 2).alias("median_duration_sec"),
        round_to(F.col("p95") / 1000, 2).alias("p95_duration_sec"),
        F.coalesce("slow", F.lit(0)).alias("slow_queries"),
    )


def _average() -> dict[str, Column]:
    """Sums over value counts from which row count and mean follow."""
    value, freq = F.col("total_elapsed_time"), F.col("freq")
    return {
        "rows": freq,
        "valued": F.when(value.isNotNull(), freq),
        "total_ms": value.cast("double") * freq,
    }


def _mean() -> Column:
    return F.try_divide(F.col("total_ms"), F.col("valued"))


def perf_by_day(qh: DataFrame, as_of) -> DataFrame:
    """Average and exact p50 / p95 / p99 seconds of successful queries per day, 7 days."""
    rows = (
        lookback(qh, "start_time", 7, "day", as_of)
        .where(F.col("execution_status") == "SUCCESS")
        .select(F.to_date("start_time").alias("day"), "total_elapsed_time")
    )
    counts = value_counts(rows, ["day"], "total_elapsed_time")
    stats = exact_percentiles(
        counts, ["day"], "total_elapsed_time", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, _average()
    )
    out = stats.select(
        "day",
        round_to(_mean() / 1000, 1).alias("avg_sec"),
        *[round_to(F.col(p) / 1000, 1).alias(f"{p}_sec") for p in ("p50", "p95", "p99")],
        F.col("rows").alias("nb_queries"),
    )
    return ordered(out, asc("day"))


def perf_by_day_long(qh: DataFrame, as_of) -> DataFrame:
    series = ["avg_sec", "p50_sec", "p95_sec", "p99_sec"]
    return unpivot(perf_by_day(qh, as_of), ["day", "nb_queries"], series, value="seconds")


def preview_queries(qh: DataFrame, n: int = 200) -> DataFrame:
    return qh.select(
        "query_id",
        "user_name",
        "warehouse_name",
        _seconds("total_elapsed_time", 2).alias("duration_sec"),
        "execution_status",
        preview_text("query_text", n).alias("query_preview"),
        "start_time",
    )


# The lists below pick their rows on the stored columns; rounding and cutting is done for
# the k rows that remain.


def slowest_queries(qh: DataFrame, start, end, k: int = 50) -> DataFrame:
    rows = (
        period_filter(qh, "start_time", start, end)
        .where(F.col("total_elapsed_time") > 0)
        .select(
            "query_id",
            "user_name",
            "warehouse_name",
            "total_elapsed_time",
            "execution_status",
            "query_text",
            "start_time",
        )
    )
    return preview_queries(top_k(rows, k, desc("total_elapsed_time")))


def slowest_with_spill(qh: DataFrame, as_of, k: int = 10) -> DataFrame:
    rows = (
        lookback(qh, "start_time", 7, "day", as_of)
        .where(F.col("warehouse_name").isNotNull())
        .select(
            "user_name",
            "warehouse_name",
            "total_elapsed_time",
            "bytes_spilled_to_local_storage",
            "bytes_spilled_to_remote_storage",
            "credits_used_cloud_services",
            "query_text",
        )
    )
    return top_k(rows, k, desc("total_elapsed_time")).select(
        "user_name",
        "warehouse_name",
        _seconds("total_elapsed_time", 1).alias("duration_sec"),
        round_to(F.col("bytes_spilled_to_local_storage") / F.lit(MIB), 1).alias("spill_local_mb"),
        round_to(F.col("bytes_spilled_to_remote_storage") / F.lit(MIB), 1).alias("spill_remote_mb"),
        round_to("credits_used_cloud_services", 5).alias("cloud_credits"),
        preview_text("query_text", 100).alias("query_preview"),
    )


def most_expensive_queries(
    qh: DataFrame, as_of, k: int = 10, n: int = 7, unit: str = "day"
) -> DataFrame:
    """Most cloud-service credits in the last ``n`` units; queries without a figure come last."""
    rows = (
        lookback(qh, "start_time", n, unit, as_of)
        .where(F.col("warehouse_name").isNotNull())
        .select(
            "query_id",
            "user_name",
            "warehouse_name",
            "total_elapsed_time",
            "credits_used_cloud_services",
            "bytes_scanned",
            "query_text",
        )
    )
    return top_k(rows, k, desc("credits_used_cloud_services")).select(
        "query_id",
        "user_name",
        "warehouse_name",
        _seconds("total_elapsed_time", 1).alias("duration_sec"),
        round_to("credits_used_cloud_services", 5).alias("cloud_credits"),
        _gb(F.col("bytes_scanned")).alias("gb_scanned"),
        preview_text("query_text", 120).alias("query_preview"),
    )


def recent_queries(qh: DataFrame, warehouse: str, as_of, k: int = 50) -> DataFrame:
    rows = (
        lookback(qh, "start_time", 1, "day", as_of)
        .where(F.col("warehouse_name") == warehouse)
        .select(
            "query_id",
            "query_text",
            "query_type",
            "execution_status",
            "start_time",
            "total_elapsed_time",
            "bytes_scanned",
        )
    )
    return top_k(rows, k, desc("start_time")).select(
        "query_id",
        "query_text",
        "query_type",
        "execution_status",
        "start_time",
        _seconds("total_elapsed_time", 2).alias("elapsed_sec"),
        round_to(F.col("bytes_scanned") / 1e6, 2).alias("mb_scanned"),
    )


def queries_by_user(qh: DataFrame, start, end, k: int = 50) -> DataFrame:
    by_user = (
        period_filter(qh, "start_time", start, end)
        .groupBy("user_name")
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            _avg_seconds(2).alias("avg_duration_sec"),
            round_to(F.sum("credits_used_cloud_services"), 4).alias("cloud_credits"),
        )
    )
    return top_k(by_user, k, desc("query_count"), asc("user_name"))


def user_activity(qh: DataFrame, as_of, k: int = 15) -> DataFrame:
    by_user = (
        lookback(qh, "start_time", 7, "day", as_of)
        .groupBy("user_name")
        .agg(
            F.count(F.lit(1)).alias("nb_queries"),
            _avg_seconds(1).alias("avg_sec"),
            _gb(F.sum("bytes_scanned")).alias("total_gb_scanned"),
            _errors().alias("errors"),
        )
    )
    return top_k(by_user, k, desc("nb_queries"), asc("user_name"))


def user_cloud_credits(qh: DataFrame, as_of, k: int = 15) -> DataFrame:
    by_user = (
        lookback(qh, "start_time", 30, "day", as_of)
        .where(F.col("user_name").isNotNull())
        .groupBy("user_name")
        .agg(
            F.count(F.lit(1)).alias("nb_queries"),
            round_to(F.sum("credits_used_cloud_services"), 4).alias("cloud_credits"),
            _avg_seconds(1).alias("avg_duration_sec"),
            _gb(F.sum("bytes_scanned")).alias("total_gb_scanned"),
        )
    )
    return top_k(by_user, k, desc("cloud_credits"), asc("user_name"))


def running_queries(qh: DataFrame, as_of, k: int = 20) -> DataFrame:
    """Started within the last hour and not finished, the longest first."""
    rows = (
        lookback(qh, "start_time", 1, "hour", as_of)
        .where(F.col("execution_status").isin("RUNNING", "QUEUED"))
        .select("user_name", "warehouse_name", "start_time", "execution_status", "query_text")
    )
    return top_k(rows, k, asc("start_time")).select(
        "user_name",
        "warehouse_name",
        seconds_between(F.col("start_time"), ntz(as_of)).alias("running_sec"),
        "execution_status",
        preview_text("query_text", 120).alias("query_preview"),
    )


def query_errors(qh: DataFrame, as_of, k: int = 20) -> DataFrame:
    by_error = (
        lookback(qh, "start_time", 1, "day", as_of)
        .where(F.col("error_code").isNotNull())
        .groupBy("user_name", "warehouse_name", "error_code", "error_message")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return top_k(by_error, k, desc("cnt"))


def failed_queries(qh: DataFrame, as_of, k: int = 50) -> DataFrame:
    """Newest failed queries of the last 7 days with their error details."""
    rows = (
        lookback(qh, "start_time", 7, "day", as_of)
        .where(F.col("execution_status") == "FAIL")
        .select("query_id", "user_name", "warehouse_name", "error_code", "error_message", "start_time")
    )
    return top_k(rows, k, desc("start_time"))


def activity_heatmap(qh: DataFrame, as_of, labels: dict[int, str] = DAY_LABELS) -> DataFrame:
    """Queries per day of week (0 = Sunday) and hour over 7 days."""
    counts = (
        lookback(qh, "start_time", 7, "day", as_of)
        .groupBy(
            (F.dayofweek("start_time") - 1).alias("dow"), F.hour("start_time").alias("hour")
        )
        .agg(F.count(F.lit(1)).alias("nb"))
    )
    label = F.lit(None).cast("string")
    for dow, text in labels.items():
        label = F.when(F.col("dow") == dow, text).otherwise(label)
    return ordered(counts.withColumn("day_label", label), asc("dow"), asc("hour"))


TASK_COLUMNS = (
    "name",
    "database_name",
    "schema_name",
    "state",
    "scheduled_time",
    "completed_time",
    "return_value",
    "error_code",
    "error_message",
)


def task_runs(th: DataFrame, databases: list[str], as_of, k: int = 100) -> DataFrame:
    rows = (
        lookback(th, "scheduled_time", 7, "day", as_of)
        .where(F.col("database_name").isin(list(databases)))
        .select(*TASK_COLUMNS)
    )
    return top_k(rows, k, desc("scheduled_time"))


def low_cache_hit(qh: DataFrame, as_of, k: int = 50, days: int = 7) -> DataFrame:
    """Queries that read least from the cache; those without a figure are left out."""
    rows = (
        lookback(qh, "start_time", days, "day", as_of)
        .where(F.col("percentage_scanned_from_cache").isNotNull() & (F.col("bytes_scanned") > 0))
        .select(
            "query_id",
            "user_name",
            "warehouse_name",
            "percentage_scanned_from_cache",
            "bytes_scanned",
            "start_time",
        )
    )
    return top_k(rows, k, asc("percentage_scanned_from_cache"), desc("bytes_scanned"))


def queued_over(qh: DataFrame, as_of, ms: int = 5000, days: int = 7) -> DataFrame:
    """Queries that waited longer than ``ms`` for provisioning, all of them and unsorted."""
    return (
        lookback(qh, "start_time", days, "day", as_of)
        .where(F.col("queued_provisioning_time") > ms)
        .select(
            "query_id",
            "user_name",
            "warehouse_name",
            _seconds("queued_provisioning_time", 2).alias("queued_sec"),
            "start_time",
        )
    )


def avg_execution(qh: DataFrame, as_of, days: int = 30) -> DataFrame:
    out = (
        lookback(qh, "start_time", days, "day", as_of)
        .where(F.col("warehouse_name").isNotNull())
        .groupBy("warehouse_name")
        .agg(
            F.count(F.lit(1)).alias("nb_queries"),
            round_to(F.avg("execution_time") / 1000, 2).alias("avg_execution_sec"),
        )
    )
    return ordered(out, desc("avg_execution_sec"), asc("warehouse_name"))


def slowest_users(qh: DataFrame, as_of, k: int = 15, days: int = 7) -> DataFrame:
    """Users by average query time."""
    by_user = (
        lookback(qh, "start_time", days, "day", as_of)
        .where(F.col("user_name").isNotNull())
        .groupBy("user_name")
        .agg(
            F.count(F.lit(1)).alias("nb_queries"),
            _avg_seconds(2).alias("avg_sec"),
            round_to(F.max("total_elapsed_time") / 1000, 2).alias("max_sec"),
        )
    )
    return top_k(by_user, k, desc("avg_sec"), asc("user_name"))
