"""Warehouse load, sizing advice, spilling, auto-suspend and resource monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import asc, desc, ordered, round_to, trunc_to
from gaugework.operators.filters import lookback
from gaugework.operators.reshape import unpivot
from gaugework.operators.storage import GIB


def warehouse_load(wl: DataFrame, as_of) -> DataFrame:
    out = (
        lookback(wl, "start_time", 30, "day", as_of)
        .groupBy("warehouse_name")
        .agg(
            round_to(F.avg("avg_running"), 3).alias("avg_running"),
            round_to(F.avg("avg_queued_load"), 3).alias("avg_queued"),
            round_to(F.max("avg_queued_load"), 3).alias("max_queued"),
            round_to(F.avg("avg_blocked"), 3).alias("avg_blocked"),
            F.count_if(F.col("avg_queued_load") > 0).alias("periods_with_queue"),
            F.count(F.lit(1)).alias("total_periods"),
        )
    )
    return ordered(out, desc("avg_queued"), asc("warehouse_name"))


def recommend_size(load: DataFrame) -> DataFrame:
    """Advice from the rounded load figures; the first rule that holds wins."""
    queued_share = F.try_divide(F.col("periods_with_queue") * 100, F.col("total_periods"))
    return load.withColumn("queue_pct", round_to(F.coalesce(queued_share, F.lit(0.0)), 0)).withColumn(
        "recommendation",
        F.when(F.col("max_queued") > 1, "SCALE_UP")
        .when(F.col("avg_queued") > 0.2, "REVIEW_SIZE")
        .when((F.col("avg_running") < 0.1) & (F.col("avg_queued") == 0), "OVERSIZED")
        .otherwise("OK"),
    )


def sizing_recommendation(wl: DataFrame, as_of) -> DataFrame:
    return recommend_size(warehouse_load(wl, as_of))


def warehouse_load_hourly(wl: DataFrame, warehouse: str, as_of) -> DataFrame:
    out = (
        lookback(wl, "start_time", 7, "day", as_of)
        .where(F.col("warehouse_name") == warehouse)
        .groupBy(trunc_to("start_time", "hour").alias("hour"))
        .agg(
            F.avg("avg_running").alias("running"),
            F.avg("avg_queued_load").alias("queued"),
            F.avg("avg_blocked").alias("blocked"),
        )
    )
    return ordered(out, asc("hour"))


def warehouse_load_hourly_long(wl: DataFrame, warehouse: str, as_of) -> DataFrame:
    return unpivot(warehouse_load_hourly(wl, warehouse, as_of), ["hour"], ["running", "queued", "blocked"])


def high_queue_flag(wl: DataFrame, warehouse: str, as_of, limit: float = 0.5) -> DataFrame:
    """Mean of the hourly means against the limit."""
    row = warehouse_load_hourly(wl, warehouse, as_of).agg(F.avg("queued").alias("avg_queued"))
    return row.withColumn("high_queue", F.coalesce(F.col("avg_queued") > limit, F.lit(False)))


def spilling_by_warehouse(qh: DataFrame, as_of) -> DataFrame:
    local, remote = "bytes_spilled_to_local_storage", "bytes_spilled_to_remote_storage"
    out = (
        lookback(qh, "start_time", 30, "day", as_of)
        .where(((F.col(local) > 0) | (F.col(remote) > 0)) & F.col("warehouse_name").isNotNull())
        .groupBy("warehouse_name")
        .agg(
            F.count(F.lit(1)).alias("nb_queries_with_spill"),
            round_to(F.sum(local) / F.lit(GIB), 2).alias("spill_local_gb"),
            round_to(F.sum(remote) / F.lit(GIB), 2).alias("spill_remote_gb"),
            round_to(F.avg("total_elapsed_time") / 1000, 1).alias("avg_duration_sec"),
        )
    )
    return ordered(out, desc("spill_remote_gb"), desc("spill_local_gb"), asc("warehouse_name"))


def normalize_warehouse_settings(df: DataFrame) -> DataFrame:
    """Lower-case headers; numbers that do not parse become NULL; cluster counts default to 1."""
    df = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    if "auto_suspend" in df.columns:
        df = df.withColumn("auto_suspend", F.col("auto_suspend").try_cast("double"))
    for col in ("min_cluster_count", "max_cluster_count"):
        if col in df.columns:
            df = df.withColumn(col, F.coalesce(F.col(col).try_cast("double"), F.lit(1.0)))
    return df


def autosuspend_eval(ws: DataFrame) -> DataFrame:
    """Two gradings of the auto-suspend delay over normalised settings; NULL means disabled."""
    delay = F.col("auto_suspend")
    whole = F.floor(delay)
    clusters = F.concat_ws(
        "-", F.col("min_cluster_count").cast("int"), F.col("max_cluster_count").cast("int")
    )
    out = ws.select(
        F.col("name").alias("warehouse_name"),
        "size",
        delay.alias("auto_suspend_sec"),
        F.when(delay.isNull(), "DISABLED")
        .when(delay <= 300, "LE_5_MIN")
        .when(delay <= 600, "LE_10_MIN")
        .otherwise("TOO_LONG")
        .alias("short_eval"),
        F.when(delay.isNull(), "DISABLED")
        .when(whole <= 60, "AGGRESSIVE")
        .when(whole <= 300, "RECOMMENDED")
        .when(whole <= 600, "MODERATE")
        .otherwise("TOO_LONG")
        .alias("detailed_eval"),
        F.when(F.col("max_cluster_count") > 1, clusters).otherwise("—").alias("multi_cluster"),
    )
    return ordered(out, desc("auto_suspend_sec", nulls="first"), asc("warehouse_name"))


def resource_monitor_status(rm: DataFrame) -> DataFrame:
    """Used share of the quota; a monitor without a quota has no share and counts as OK."""
    used = F.try_divide(F.col("used_credits"), F.col("credit_quota")) * 100
    out = rm.withColumn("pct_used", round_to(used, 1)).select(
        "name",
        "credit_quota",
        "used_credits",
        "remaining_credits",
        "pct_used",
        F.when(F.col("pct_used") >= 90, "CRITICAL")
        .when(F.col("pct_used") >= 70, "WATCH")
        .otherwise("OK")
        .alias("alert"),
        "owner",
    )
    return ordered(out, desc("pct_used"), asc("name"))
