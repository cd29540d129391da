"""Quota status of warehouses and services, and the alerts that follow from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import asc, desc, ntz, ordered, period_start, round_to, trunc_to
from gaugework.operators.filters import since

# Quota bands in percent, their status below the top band, and the labels of
# the top band for warehouses and services.
THRESHOLDS = (70.0, 85.0, 95.0, 100.0)
BAND_STATUS = ((0.95, "CRITICAL"), (0.85, "ACTION_REQUIRED"), (0.70, "MONITORING"))
WAREHOUSE_TOP = "SUSPENDED"
SERVICE_TOP = "EXCEEDED"

FREQUENCIES = ("DAILY", "WEEKLY", "MONTHLY", "YEARLY")

STATUS_COLORS = {
    "OK": "green",
    "MONITORING": "orange",
    "ACTION_REQUIRED": "darkorange",
    "CRITICAL": "red",
    "SUSPENDED": "darkred",
    "EXCEEDED": "darkred",
}


def status_of(ratio: Column, top_label: str) -> Column:
    """Band of the unrounded used / limit ratio; NULL (no usable limit) is NO_LIMIT."""
    status = F.when(ratio.isNull(), "NO_LIMIT").when(ratio >= 1, top_label)
    for bound, label in BAND_STATUS:
        status = status.when(ratio >= bound, label)
    return status.otherwise("OK")


def _used_per_period(usage: DataFrame, key: str, as_of, honor_frequency: bool) -> DataFrame:
    """One row per resource with the credits of each accounting period, in one pass."""
    if not honor_frequency:
        rows = since(usage, "start_time", period_start(as_of, "DAILY"), as_of)
        sums = [F.sum("credits_used").alias("used_daily")]
    else:
        starts = {f: period_start(as_of, f) for f in FREQUENCIES}
        # The week may begin before the year does.
        rows = since(usage, "start_time", min(starts.values()), as_of)
        sums = [
            F.sum(F.when(F.col("start_time") >= ntz(s), F.col("credits_used"))).alias(f"used_{f.lower()}")
            for f, s in starts.items()
        ]
    if "end_time" in usage.columns:
        sums.append(F.max("end_time").alias("max_time"))
    return rows.groupBy(key).agg(*sums)


def quota_status(
    config: DataFrame,
    usage: DataFrame,
    key: str,
    top_label: str,
    as_of,
    honor_frequency: bool = False,
) -> DataFrame:
    """Active quotas against what was used.

    Usage is aggregated to one row per resource before the join, so a resource that
    holds most of the log costs one row there.  By default every quota is compared with
    today's usage; ``honor_frequency`` uses each quota's own period and skips NEVER.
    """
    active = config.where(F.col("is_active"))
    if honor_frequency:
        active = active.where(F.col("frequency") != "NEVER")
    used = _used_per_period(usage, key, as_of, honor_frequency)
    joined = active.join(used, key, "left")
    if honor_frequency:
        credits = F.lit(None).cast("double")
        for f in FREQUENCIES:
            credits = F.when(F.col("frequency") == f, F.col(f"used_{f.lower()}")).otherwise(credits)
    else:
        credits = F.col("used_daily")
    joined = joined.withColumn("_used", F.coalesce(credits, F.lit(0.0)))
    ratio = F.try_divide(F.col("_used"), F.col("credit_limit").cast("double"))
    columns = [
        F.col(key),
        F.col("frequency"),
        F.col("credit_limit"),
        F.col("_used").alias("credits_used"),
        round_to(ratio * 100, 1).alias("pct_used"),
        status_of(ratio, top_label).alias("status"),
        (F.col("credit_limit").cast("double") - F.col("_used")).alias("credits_remaining"),
        F.array_join("alert_emails", ", ").alias("alert_recipients"),
    ]
    if "auto_suspend_at_100" in config.columns:
        columns.insert(5, F.col("auto_suspend_at_100"))
    if "max_time" in used.columns:
        columns.append(F.coalesce("max_time", ntz(as_of)).alias("data_as_of"))
    return ordered(joined.select(*columns), desc("pct_used"), asc(key))


def quota_status_counts(status: DataFrame) -> DataFrame:
    s = F.col("status")
    return status.agg(
        F.count_if(s == "OK").alias("ok"),
        F.count_if(s == "MONITORING").alias("monitoring"),
        F.count_if(s == "ACTION_REQUIRED").alias("action_required"),
        F.count_if(s.isin("CRITICAL", WAREHOUSE_TOP, SERVICE_TOP)).alias("critical"),
    )


def gauge_band(pct: str = "pct_used") -> Column:
    value = F.coalesce(F.col(pct), F.lit(0.0))
    return (
        F.when(value >= 100, "red")
        .when(value >= 85, "orange")
        .when(value >= 70, "yellow")
        .otherwise("green")
    )


def status_color(status: str = "status") -> Column:
    color = F.lit("gray")
    for label, name in STATUS_COLORS.items():
        color = F.when(F.col(status) == label, name).otherwise(color)
    return color


ALERT_KEY = ("scope", "resource_name", "window_start", "threshold_pct")


def crossed_thresholds(
    used: DataFrame, config: DataFrame, key: str, scope: str, top_label: str
) -> DataFrame:
    """One row per (resource, window, threshold reached).

    ``used`` holds ``key, window_start, credits_used``, already aggregated.  A threshold
    switched off in the configuration raises nothing; 100 % always does.
    """
    switches = []
    for t in THRESHOLDS:
        column = f"alert_threshold_{t:.0f}"
        on = F.col(column) if column in config.columns else F.lit(True)
        switches.append(F.struct(F.lit(t).alias("threshold_pct"), on.alias("on")))
    active = config.where(F.col("is_active") & (F.col("credit_limit") > 0)).select(
        key, F.col("credit_limit").cast("double").alias("credit_limit"), F.array(*switches).alias("levels")
    )
    joined = used.join(active, key).withColumn("level", F.explode("levels"))
    reached = joined.where(
        F.col("level.on")
        & (F.col("credits_used") / F.col("credit_limit") >= F.col("level.threshold_pct") / 100)
    )
    status = F.when(F.col("level.threshold_pct") >= 100, top_label)
    for bound, label in BAND_STATUS:
        status = status.when(F.col("level.threshold_pct") >= bound * 100, label)
    return reached.select(
        F.lit(scope).alias("scope"),
        F.col(key).alias("resource_name"),
        "window_start",
        F.col("level.threshold_pct").alias("threshold_pct"),
        "credits_used",
        "credit_limit",
        status.alias("status"),
        F.concat(
            F.col(key), F.lit(" reached "), F.col("level.threshold_pct").cast("int"), F.lit("% of its quota")
        ).alias("message"),
    )


def _frequency(config: DataFrame) -> Column:
    return F.col("frequency") if "frequency" in config.columns else F.lit("DAILY")


def _period_of(day: Column, frequency: Column) -> Column:
    """Start of the accounting period that a day falls into; NULL for NEVER."""
    date = F.to_date(day)
    start = (
        F.when(frequency == "DAILY", date)
        .when(frequency == "WEEKLY", F.trunc(date, "week"))
        .when(frequency == "MONTHLY", F.trunc(date, "month"))
        .when(frequency == "YEARLY", F.trunc(date, "year"))
    )
    return start.cast("timestamp_ntz")


def used_per_period(daily: DataFrame, config: DataFrame, key: str, start=None) -> DataFrame:
    """``key, window_start, credits_used`` in the periods of each quota's own frequency.

    ``daily`` holds ``key, day, credits_used``.  With ``start``, periods that were over by then are
    left out.
    """
    quotas = config.where(F.col("is_active")).select(key, _frequency(config).alias("_frequency"))
    periods = daily.join(quotas, key).withColumn("window_start", _period_of(F.col("day"), F.col("_frequency")))
    wanted = F.col("window_start").isNotNull()
    if start is not None:
        wanted = wanted & (F.col("window_start") >= _period_of(ntz(start), F.col("_frequency")))
    return periods.where(wanted).groupBy(key, "window_start").agg(F.sum("credits_used").alias("credits_used"))


def earliest_period_start(start) -> dt.datetime:
    """The usage that periods around ``start`` can need begins here."""
    return min(period_start(start, f) for f in FREQUENCIES)


def evaluate_quota_alerts(
    config: DataFrame,
    usage: DataFrame,
    key: str,
    scope: str,
    top_label: str,
    start,
    as_of,
) -> DataFrame:
    """Batch form of the alert stream: every threshold reached in the periods from ``start`` to ``as_of``.

    Usage is read from the start of the longest period only, and summed by day first.  Together with
    :func:`not_yet_alerted` this adds what a stream had to drop as too late.
    """
    rows = since(usage, "start_time", earliest_period_start(start), as_of)
    daily = rows.groupBy(key, trunc_to("start_time", "day").alias("day")).agg(
        F.sum("credits_used").alias("credits_used")
    )
    return crossed_thresholds(used_per_period(daily, config, key, start), config, key, scope, top_label)


def not_yet_alerted(alerts: DataFrame, log: DataFrame) -> DataFrame:
    return alerts.join(log.select(*ALERT_KEY), list(ALERT_KEY), "left_anti")
