"""Credit consumption: metering aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions import (
    add_months,
    asc,
    desc,
    month_start,
    ntz,
    ordered,
    round_to,
    top_k,
    trunc_to,
)
from gaugework.operators.filters import in_list, lookback, lookback_start, period_filter, since
from gaugework.operators.reshape import union_all

# Price of a credit in USD, service that meters warehouses.
CREDIT_COST_USD = 4.0
WAREHOUSE_SERVICE = "WAREHOUSE_METERING"


def _not_warehouse() -> Column:
    return F.col("service_type") != WAREHOUSE_SERVICE


def _credits(digits: int, col: str = "credits_used") -> Column:
    return round_to(F.sum(col), digits)


def credits_by_period(
    wm: DataFrame, grain: str, start=None, end=None, as_of=None
) -> DataFrame:
    """Credits per warehouse and hour, day (given period) or month (last 12 months)."""
    if grain == "month":
        rows, digits = lookback(wm, "start_time", 12, "month", as_of, from_midnight=True), 2
    else:
        rows, digits = period_filter(wm, "start_time", start, end), 4
    out = rows.groupBy("warehouse_name", trunc_to("start_time", grain).alias("period")).agg(
        _credits(digits).alias("credits_used")
    )
    first, second = ("period", "warehouse_name") if grain == "hour" else ("warehouse_name", "period")
    return ordered(out, asc(first), asc(second))


def total_credits(df: DataFrame, start, end, exclude: tuple[str, ...] = ()) -> DataFrame:
    rows = period_filter(df, "start_time", start, end)
    if exclude:
        rows = rows.where(~F.col("service_type").isin(list(exclude)))
    return rows.agg(F.coalesce(F.sum("credits_used"), F.lit(0.0)).alias("total"))


def overview_kpis(
    wm: DataFrame, mt: DataFrame, qh: DataFrame, start, end, cost: float = CREDIT_COST_USD
) -> DataFrame:
    """One row of headline figures; the three logs are aggregated in one stacked pass."""
    warehouses = period_filter(wm, "start_time", start, end).select(F.col("credits_used").alias("wh"))
    services = (
        period_filter(mt, "start_time", start, end)
        .where(_not_warehouse())
        .select(F.col("credits_used").alias("sl"))
    )
    queries = period_filter(qh, "start_time", start, end).select(F.lit(1).alias("q"))
    sums = union_all(warehouses, services, queries).agg(
        F.coalesce(F.sum("wh"), F.lit(0.0)).alias("warehouse_credits"),
        F.coalesce(F.sum("sl"), F.lit(0.0)).alias("serverless_credits"),
        F.count("q").alias("total_queries"),
    )
    total = F.col("warehouse_credits") + F.col("serverless_credits")
    return sums.withColumn("total_credits", total).withColumn("total_cost", total * F.lit(cost))


def category_split(overview: DataFrame) -> DataFrame:
    """Two rows, Warehouses and Serverless; empty when nothing was used."""
    return (
        overview.where(F.col("total_credits") > 0)
        .select(
            F.col("warehouse_credits").alias("Warehouses"), F.col("serverless_credits").alias("Serverless")
        )
        .unpivot([], ["Warehouses", "Serverless"], "category", "credits")
    )


def hourly_by_category(wm: DataFrame, mt: DataFrame, start, end) -> DataFrame:
    """Hourly credits of both categories.

    The warehouse side adds up the per-warehouse hours already rounded to 4 digits;
    the serverless side is not rounded.
    """
    by_warehouse = (
        period_filter(wm, "start_time", start, end)
        .groupBy("warehouse_name", trunc_to("start_time", "hour").alias("period"))
        .agg(_credits(4).alias("rounded"))
    )
    warehouses = by_warehouse.groupBy("period").agg(F.sum("rounded").alias("credits_used"))
    services = (
        period_filter(mt, "start_time", start, end)
        .where(_not_warehouse())
        .groupBy(trunc_to("start_time", "hour").alias("period"))
        .agg(F.sum("credits_used").alias("credits_used"))
    )
    both = union_all(
        warehouses.withColumn("category", F.lit("Warehouse")),
        services.withColumn("category", F.lit("Serverless")),
    )
    return ordered(both.select("period", "category", "credits_used"), asc("category"), asc("period"))


def service_hourly(mt: DataFrame, service: str, start, end) -> DataFrame:
    out = (
        period_filter(mt, "start_time", start, end)
        .where(F.col("service_type") == service)
        .groupBy(trunc_to("start_time", "hour").alias("period"))
        .agg(_credits(4).alias("credits_used"))
    )
    return ordered(out, asc("period"))


def service_total(mt: DataFrame, service: str, start, end, cost: float = CREDIT_COST_USD) -> DataFrame:
    """Total and cost over the rounded hours of :func:`service_hourly`."""
    total = F.coalesce(F.sum("credits_used"), F.lit(0.0))
    return service_hourly(mt, service, start, end).agg(
        total.alias("total"), (total * F.lit(cost)).alias("total_cost")
    )


def service_types(mt: DataFrame, start, end) -> DataFrame:
    """Services other than warehouses that were active in the period."""
    return (
        period_filter(mt, "start_time", start, end)
        .where(_not_warehouse())
        .select("service_type")
        .distinct()
        .orderBy(asc("service_type"))
    )


def serverless_top_consumers(mt: DataFrame, as_of, service: str | None = None, k: int = 50) -> DataFrame:
    """The ``k`` services with the most credits; a chosen ``service`` is found whatever its rank."""
    by_service = (
        in_list(lookback(mt, "start_time", 30, "day", as_of), "service_type", [service] if service else [])
        .where(_not_warehouse())
        .groupBy("service_type")
        .agg(_credits(2).alias("total_credits"), F.count(F.lit(1)).alias("periods_active"))
    )
    return top_k(by_service, k, desc("total_credits"))


def serverless_daily_trend(mt: DataFrame, as_of) -> DataFrame:
    out = (
        lookback(mt, "start_time", 30, "day", as_of, from_midnight=True)
        .where(_not_warehouse())
        .groupBy(trunc_to("start_time", "day").alias("day_date"), "service_type")
        .agg(_credits(4).alias("credits_used"))
    )
    return ordered(out, desc("day_date"), desc("credits_used"), asc("service_type"))


def warehouse_cost(wm: DataFrame, start, end, cost: float = CREDIT_COST_USD) -> DataFrame:
    out = (
        period_filter(wm, "start_time", start, end)
        .groupBy("warehouse_name")
        .agg(
            _credits(2).alias("total_credits"),
            round_to(F.sum("credits_used") * F.lit(cost), 2).alias("estimated_cost_usd"),
            F.count(F.lit(1)).alias("metering_events"),
        )
    )
    return ordered(out, desc("total_credits"), asc("warehouse_name"))


def credits_month_over_month(mt: DataFrame, as_of) -> DataFrame:
    """This month, last month and last 7 days in one pass.

    ``delta_pct`` compares the rounded months; NULL when last month has no credits.
    """
    this_month = month_start(as_of)
    last_month = add_months(this_month, -1)
    ts, used = F.col("start_time"), F.col("credits_used")

    def part(cond: Column) -> Column:
        return F.coalesce(round_to(F.sum(F.when(cond, used)), 2), F.lit(0.0))

    row = since(mt, "start_time", last_month, as_of).agg(
        part(ts >= ntz(this_month)).alias("credits_this_month"),
        part(ts < ntz(this_month)).alias("credits_last_month"),
        part(ts >= ntz(lookback_start(as_of, 7, "day"))).alias("credits_7d"),
    )
    now, before = F.col("credits_this_month"), F.col("credits_last_month")
    return row.withColumn("delta_pct", F.when(before > 0, (now - before) / before * 100))


def credits_by_service(mt: DataFrame, as_of) -> DataFrame:
    """All services, warehouses included."""
    out = (
        lookback(mt, "start_time", 30, "day", as_of)
        .groupBy("service_type")
        .agg(_credits(2).alias("credits"))
    )
    return ordered(out, desc("credits"), asc("service_type"))


def service_share_pct(mt: DataFrame, as_of) -> DataFrame:
    """Credits per service and share of the grand total.

    The window runs over one row per service, after the aggregation.
    """
    by_service = (
        lookback(mt, "start_time", 30, "day", as_of)
        .groupBy("service_type")
        .agg(F.sum("credits_used").alias("used"))
    )
    share = F.try_divide(F.col("used") * 100, F.sum("used").over(Window.partitionBy()))
    out = by_service.select(
        "service_type", round_to("used", 2).alias("credits"), round_to(share, 1).alias("pct")
    )
    return ordered(out, desc("credits"), asc("service_type"))


def credits_by_day(mt: DataFrame, as_of) -> DataFrame:
    out = (
        lookback(mt, "start_time", 30, "day", as_of)
        .groupBy(F.to_date("start_time").alias("day"))
        .agg(_credits(3).alias("credits"))
    )
    return ordered(out, asc("day"))


def credits_by_day_service(mt: DataFrame, as_of) -> DataFrame:
    out = (
        lookback(mt, "start_time", 30, "day", as_of)
        .groupBy(F.to_date("start_time").alias("day"), "service_type")
        .agg(_credits(3).alias("credits"))
    )
    return ordered(out, asc("day"), asc("service_type"))


def warehouse_usage(wm: DataFrame, as_of) -> DataFrame:
    out = (
        lookback(wm, "start_time", 30, "day", as_of)
        .groupBy("warehouse_name")
        .agg(
            _credits(2).alias("total_credits"),
            round_to(F.avg("credits_used"), 4).alias("avg_credits_per_hour"),
            F.countDistinct(F.to_date("start_time")).alias("days_active"),
        )
    )
    return ordered(out, desc("total_credits"), asc("warehouse_name"))


def warehouse_daily_rate(wm: DataFrame, as_of) -> DataFrame:
    days = F.countDistinct(F.to_date("start_time"))
    out = (
        lookback(wm, "start_time", 30, "day", as_of)
        .groupBy("warehouse_name")
        .agg(
            _credits(2).alias("total_credits"),
            days.alias("active_days"),
            round_to(F.try_divide(F.sum("credits_used"), days), 2).alias("credits_per_day"),
        )
    )
    return ordered(out, desc("total_credits"), asc("warehouse_name"))


def project_warehouse_credits(wm: DataFrame, warehouse: str, as_of) -> DataFrame:
    out = (
        lookback(wm, "start_time", 7, "day", as_of)
        .where(F.col("warehouse_name") == warehouse)
        .groupBy(F.to_date("start_time").alias("day"))
        .agg(
            _credits(4, "credits_used_compute").alias("credits_compute"),
            _credits(4, "credits_used_cloud_services").alias("credits_cloud"),
        )
    )
    return ordered(out, asc("day"))


def pivot_hours(wm: DataFrame, start, end) -> DataFrame:
    """Warehouse x hour of day over the rounded hours; always 24 columns, 0 where idle.

    The hours are given, so no extra job looks for them.
    """
    hourly = (
        period_filter(wm, "start_time", start, end)
        .groupBy("warehouse_name", trunc_to("start_time", "hour").alias("period"))
        .agg(_credits(4).alias("credits_used"))
    )
    wide = (
        hourly.withColumn("h", F.concat(F.lit("h"), F.hour("period")))
        .groupBy("warehouse_name")
        .pivot("h", [f"h{i}" for i in range(24)])
        .agg(F.sum("credits_used"))
    )
    return wide.na.fill(0.0)
