"""Alerts raised while usage arrives, each of them once.

Sums run in event-time windows with a watermark, in update mode: append mode would emit
a day only once it has closed, too late for an alert.  Rows later than the watermark are
dropped by Spark and counted in the query progress (:func:`late_rows`); :func:`settle_late_usage` then
corrects the totals of the closed days from the log and adds the alerts that they raise.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugework.functions import utc_instant, utc_wall_clock
from gaugework.operators.filters import since
from gaugework.operators.quota import ALERT_KEY, crossed_thresholds, earliest_period_start, used_per_period
from gaugework.streaming.batches import BATCH, STREAM, read_batches, stream_id, trigger, write_batch

QUOTA_ALERT = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("resource_name", T.StringType()),
        T.StructField("window_start", T.TimestampNTZType()),
        T.StructField("threshold_pct", T.DoubleType()),
        T.StructField("credits_used", T.DoubleType()),
        T.StructField("credit_limit", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

LOGIN_ALERT = T.StructType(
    [
        T.StructField("client_ip", T.StringType()),
        T.StructField("window_start", T.TimestampNTZType()),
        T.StructField("failed_attempts", T.LongType()),
    ]
)


WINDOW_DATE = "window_date"

#: Streams of this name hold totals of closed days that were corrected from the log.
SETTLED = "settled-"


def _append_once(
    spark: SparkSession,
    alerts: DataFrame,
    key: Sequence[str],
    schema: T.StructType,
    out: str,
    place: tuple[str, int],
) -> None:
    """Store the alerts that are not stored yet, in folders by the date of their window.

    Only the dates of the batch's own windows are read back, and those are not older than the
    watermark allows: the cost of a trigger does not grow with the log.
    """
    alerts = alerts.withColumn(WINDOW_DATE, F.to_date("window_start")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        oldest = alerts.agg(F.min(WINDOW_DATE)).first()[0]
        # Only batches that raise something leave a folder.
        if oldest is None:
            return
        logged = T.StructType([*schema.fields, T.StructField(WINDOW_DATE, T.DateType())])
        seen = read_batches(spark, out, logged, exclude=place).where(F.col(WINDOW_DATE) >= F.lit(oldest))
        fresh = alerts.join(seen.select(*key), list(key), "left_anti")
        fresh = fresh.select(*schema.fieldNames(), WINDOW_DATE).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not fresh.isEmpty():
                write_batch(fresh, out, *place, partition_by=[WINDOW_DATE])
        finally:
            fresh.unpersist()
    finally:
        alerts.unpersist()


def _windowed(
    df: DataFrame,
    ts_col: str,
    keys: Sequence[str],
    total: Column,
    watermark: str,
    window: str,
    slide: str | None = None,
) -> DataFrame:
    at = df.withColumn("_at", utc_instant(ts_col)).withWatermark("_at", watermark)
    span = F.window("_at", window, slide) if slide else F.window("_at", window)
    return (
        at.groupBy(span.alias("span"), *keys)
        .agg(total)
        .withColumn("window_start", utc_wall_clock(F.col("span.start")))
        .drop("span")
    )


def _day_totals_schema(key: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(key, T.StringType()),
            T.StructField("credits_used", T.DoubleType()),
            T.StructField("day", T.DateType()),
        ]
    )


def day_totals(spark: SparkSession, totals: str, key: str, start: dt.date) -> DataFrame:
    """``key, day, credits_used`` as they are stored, from ``start`` on.

    Within a stream the total of the last batch counts, so a correction can lower a day.  A settled
    total comes before those of the streams; of several streams over one log the largest total counts, which
    is that of the one that has read most.
    """
    stored = read_batches(spark, totals, _day_totals_schema(key), origin=True).where(F.col("day") >= F.lit(start))
    latest = stored.groupBy(key, "day", STREAM).agg(F.max_by("credits_used", BATCH).alias("credits_used"))
    rank = F.struct(F.col(STREAM).startswith(SETTLED), "credits_used")
    return latest.groupBy(key, "day").agg(F.max_by("credits_used", rank).alias("credits_used"))


def _raise_quota_alerts(
    spark: SparkSession,
    oldest: dt.date,
    quotas: DataFrame,
    key: str,
    scope: str,
    top_label: str,
    out: str,
    totals: str,
    place: tuple[str, int],
) -> None:
    """Log what the periods from that of ``oldest`` on have reached by the stored totals."""
    days = day_totals(spark, totals, key, earliest_period_start(oldest).date())
    used = used_per_period(days, quotas, key, oldest)
    alerts = crossed_thresholds(used, quotas, key, scope, top_label)
    _append_once(spark, alerts, ALERT_KEY, QUOTA_ALERT, out, place)


def stream_quota_alerts(
    spark: SparkSession,
    usage: DataFrame,
    config: DataFrame | Callable[[], DataFrame],
    key: str,
    scope: str,
    top_label: str,
    out: str,
    totals: str,
    checkpoint: str,
    watermark: str = "1 day",
    cadence: str | None = None,
) -> StreamingQuery:
    """Log every quota threshold (70 / 85 / 95 / 100 %) a resource reaches in its quota's period.

    The stream sums by day; the day totals are stored under ``totals`` by date, and a batch adds those of the
    periods it touches, so weekly to yearly quotas need no state that lives as long as they do.
    ``config`` may be a function: it is then asked again for every batch, so edited quotas count from the
    next batch on.
    """
    daily = _windowed(
        usage, "start_time", [key], F.sum("credits_used").alias("credits_used"), watermark, "1 day"
    )
    stream = stream_id(spark, checkpoint)

    def raise_alerts(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(key, "credits_used", F.to_date("window_start").alias("day"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            oldest = rows.agg(F.min("day")).first()[0]
            if oldest is None:
                return
            write_batch(rows, totals, stream, batch_id, partition_by=["day"])
        finally:
            rows.unpersist()
        quotas = config() if callable(config) else config
        _raise_quota_alerts(spark, oldest, quotas, key, scope, top_label, out, totals, (stream, batch_id))

    return (
        daily.writeStream.outputMode("update")
        .foreachBatch(raise_alerts)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(cadence))
        .start()
    )


def late_rows(query: StreamingQuery) -> tuple[int, dt.datetime | None]:
    """Rows that a stateful stream dropped as too late, and its watermark (UTC).

    Counted over the progress that Spark keeps (``spark.sql.streaming.numRecentProgressUpdates`` triggers).  Rows
    of one key and window that arrive in one task count as one.
    """
    dropped, marks = 0, []
    for progress in query.recentProgress:
        dropped += sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
        if "watermark" in progress["eventTime"]:
            marks.append(dt.datetime.fromisoformat(progress["eventTime"]["watermark"]).replace(tzinfo=None))
    return dropped, max(marks, default=None)


def settle_late_usage(
    spark: SparkSession,
    usage: DataFrame,
    config: DataFrame,
    key: str,
    scope: str,
    top_label: str,
    out: str,
    totals: str,
    checkpoint: str,
    start: dt.datetime,
    watermark: dt.datetime,
) -> None:
    """Bring totals and alerts of the days from ``start`` up to the stream's ``watermark`` in line with the log.

    ``usage`` is the log as a batch.  Only days that the stream has closed are summed again, so the stream never
    adds to a settled day; totals are written where they differ.  Alerts that the corrected periods
    raise are added, none is withdrawn.  A run that broke off can be repeated: it writes and logs what is missing.
    """
    start = dt.datetime.combine(start, dt.time())
    closed = dt.datetime.combine(watermark, dt.time())
    if closed <= start:
        return
    name = SETTLED + stream_id(spark, checkpoint)
    rows = since(usage, "start_time", start, closed).where(F.col("start_time") < F.lit(closed).cast("timestamp_ntz"))
    summed = rows.groupBy(key, F.to_date("start_time").alias("day")).agg(F.sum("credits_used").alias("credits_used"))
    stored = day_totals(spark, totals, key, start.date()).withColumnRenamed("credits_used", "_stored")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (key, "day")]
    both = summed.alias("s").join(stored.alias("t"), same, "left")
    # The order of summation may change the last bits.
    off = F.abs(F.col("credits_used") - F.col("_stored")) > 1e-9 * F.greatest(F.abs("credits_used"), F.lit(1.0))
    changed = both.where(F.coalesce(off, F.lit(True))).select(f"s.{key}", "credits_used", "s.day")
    past = read_batches(spark, totals, _day_totals_schema(key), origin=True).where(F.col(STREAM) == name)
    number = past.agg(F.coalesce(F.max(BATCH), F.lit(-1))).first()[0] + 1
    changed = changed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if not changed.isEmpty():
            write_batch(changed, totals, name, number, partition_by=["day"])
    finally:
        changed.unpersist()
    logged = read_batches(spark, out, QUOTA_ALERT, origin=True).where(F.col(STREAM) == name)
    turn = logged.agg(F.coalesce(F.max(BATCH), F.lit(-1))).first()[0] + 1
    _raise_quota_alerts(spark, start.date(), config, key, scope, top_label, out, totals, (name, turn))


def stream_failed_login_alerts(
    spark: SparkSession,
    logins: DataFrame,
    min_failed: int,
    out: str,
    checkpoint: str,
    window: str = "6 hours",
    slide: str = "1 hour",
    watermark: str = "1 day",
    cadence: str | None = None,
) -> StreamingQuery:
    """Log every address that fails ``min_failed`` logins within a sliding window."""
    failed = logins.where(F.col("is_success") == "NO")
    counts = _windowed(
        failed,
        "event_timestamp",
        ["client_ip"],
        F.count(F.lit(1)).alias("failed_attempts"),
        watermark,
        window,
        slide,
    )
    stream = stream_id(spark, checkpoint)

    def raise_alerts(batch: DataFrame, batch_id: int) -> None:
        alerts = batch.where(F.col("failed_attempts") >= min_failed)
        _append_once(spark, alerts, ("client_ip", "window_start"), LOGIN_ALERT, out, (stream, batch_id))

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(raise_alerts)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(cadence))
        .start()
    )
