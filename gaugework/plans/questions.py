"""Named questions that combine several logs; each side is aggregated before it is joined."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import (
    add_months,
    asc,
    desc,
    month_start,
    ordered,
    round_to,
    top_k,
    trunc_to,
)
from gaugework.operators.cost import CREDIT_COST_USD
from gaugework.operators.filters import lookback, since
from gaugework.operators.reshape import union_all


def failed_logins_and_expensive_queries(
    lh: DataFrame, qh: DataFrame, as_of, min_failed: int = 1, k: int = 50, days: int = 30
) -> DataFrame:
    """Users with failed logins, by the cloud credits of their queries."""
    failures = (
        lookback(lh, "event_timestamp", days, "day", as_of)
        .where(F.col("is_success") == "NO")
        .groupBy("user_name")
        .agg(F.count(F.lit(1)).alias("failed_logins"))
        .where(F.col("failed_logins") >= min_failed)
    )
    spending = (
        lookback(qh, "start_time", days, "day", as_of)
        .groupBy("user_name")
        .agg(
            round_to(F.sum("total_elapsed_time") / 1000, 2).alias("total_sec"),
            round_to(F.sum("credits_used_cloud_services"), 4).alias("cloud_credits"),
        )
    )
    both = failures.join(spending, "user_name")
    return top_k(both, k, desc("cloud_credits"), asc("user_name"))


def expensive_failing_warehouses(wm: DataFrame, qh: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Warehouses by credits, with their failed queries."""
    credits = (
        lookback(wm, "start_time", days, "day", as_of)
        .groupBy("warehouse_name")
        .agg(round_to(F.sum("credits_used"), 2).alias("total_credits"))
    )
    failures = (
        lookback(qh, "start_time", days, "day", as_of)
        .groupBy("warehouse_name")
        .agg(
            F.count_if(F.col("execution_status") == "FAIL").alias("failed_queries"),
            F.count(F.lit(1)).alias("total_queries"),
        )
    )
    both = credits.join(failures, "warehouse_name", "left").na.fill(0, ["failed_queries", "total_queries"])
    return ordered(both, desc("total_credits"), desc("failed_queries"), asc("warehouse_name"))


def total_cost(mt: DataFrame, as_of, cost: float = CREDIT_COST_USD) -> DataFrame:
    """Credits and cost of all services this month."""
    row = since(mt, "start_time", month_start(as_of), as_of).agg(
        F.coalesce(F.sum("credits_used"), F.lit(0.0)).alias("credits")
    )
    return row.select(
        round_to("credits", 2).alias("credits"), round_to(F.col("credits") * F.lit(cost), 2).alias("cost_usd")
    )


def total_cost_by_service(mt: DataFrame, as_of, cost: float = CREDIT_COST_USD) -> DataFrame:
    out = (
        since(mt, "start_time", month_start(as_of), as_of)
        .groupBy("service_type")
        .agg(
            round_to(F.sum("credits_used"), 2).alias("credits"),
            round_to(F.sum("credits_used") * F.lit(cost), 2).alias("cost_usd"),
        )
    )
    return ordered(out, desc("credits"), asc("service_type"))


# Operation -> its log and the column that counts bytes.
_OPERATIONS = {
    "pipe": ("pipe_usage_history", "bytes_inserted"),
    "clustering": ("automatic_clustering_history", "num_bytes_reclustered"),
    "serverless_task": ("serverless_task_history", None),
    "materialized_views": ("materialized_view_refresh_history", None),
    "replication": ("replication_usage_history", "bytes_transferred"),
}


def ops_cost_summary(logs: Mapping[str, DataFrame], as_of, months: int = 1) -> DataFrame:
    """Credits and bytes per month of background services, from the start of the month
    ``months`` before the current one.  ``logs`` maps usage-log names to frames; operations whose
    log is not given are left out."""
    first = add_months(month_start(as_of), -months)
    parts = []
    for operation, (log, amount) in _OPERATIONS.items():
        if log in logs:
            used = F.col(amount).cast("bigint") if amount else F.lit(None).cast("bigint")
            parts.append(
                since(logs[log], "start_time", first, as_of).select(
                    F.lit(operation).alias("operation"),
                    trunc_to("start_time", "month").alias("month"),
                    "credits_used",
                    used.alias("bytes"),
                )
            )
    out = union_all(*parts).groupBy("operation", "month").agg(
        round_to(F.sum("credits_used"), 2).alias("credits"), F.sum("bytes").alias("bytes")
    )
    return ordered(out, asc("operation"), asc("month"))


def daily_credit_trend(daily: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Billable credits per day."""
    out = (
        lookback(daily, "usage_date", days, "day", as_of, from_midnight=True)
        .groupBy("usage_date")
        .agg(round_to(F.sum("credits_used"), 3).alias("credits"))
    )
    return ordered(out, asc("usage_date"))
