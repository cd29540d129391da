"""Streams over the test tables, run to the end of what is there; the sink is compared."""

import datetime as dt

from pyspark.sql import functions as F

from gaugework.operators.landing import TECHNICAL, landing_enrich
from gaugework.operators.quota import SERVICE_TOP, WAREHOUSE_TOP, used_per_period
from gaugework.sources.tables import VersionedTable
from gaugework.streaming.alerts import (
    LOGIN_ALERT,
    QUOTA_ALERT,
    day_totals,
    late_rows,
    settle_late_usage,
    stream_failed_login_alerts,
    stream_quota_alerts,
)
from gaugework.streaming.batches import read_batches
from gaugework.streaming.load import compact, incremental_refresh, presented, stream_load

from checks.registry import EVENTS, R, query, rounded, scratch
from checks.sizing import SERVICE_ALERTS, alerts_sql


def _finish(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query(
    "stream_load",
    "",
    f"""SELECT event_id, ts, user_id, event_type, value, props, TIMESTAMP '{EVENTS}' AS _loaded_at, true AS _is_current
        FROM events""",
)
def _(t):
    root = scratch(t.spark, "stream-load")
    events = t.table("events")
    micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    events.write.partitionBy("event_type").options(**micros).json(f"{root}/in")
    # Each event type is a folder of files; the type itself is read back from the path.
    schema = events.drop("event_type").schema
    for _ in range(2):  # the second run finds no new file
        _finish(
            stream_load(
                t.spark, f"{root}/in/event_type=*", "json", schema, f"{root}/out", f"{root}/log",
                f"{root}/checkpoint", as_of=EVENTS, max_files=3,
            )
        )
    rows = t.spark.read.parquet(f"{root}/out")
    kind = F.regexp_extract("_source_file", "event_type=([a-z]+)", 1)
    return rows.select(
        "event_id", "ts", "user_id", kind.alias("event_type"), "value", "props", "_loaded_at", "_is_current"
    )


@query(
    "stream_load_log",
    "",
    "SELECT o_orderstatus AS folder, count(*) AS row_count, count(*) AS row_parsed, CAST(0 AS BIGINT) AS error_count FROM orders GROUP BY 1",
)
def _(t):
    root = scratch(t.spark, "stream-log")
    orders = t.table("orders")
    orders.write.partitionBy("o_orderstatus").option("header", "true").csv(f"{root}/in")
    schema = orders.drop("o_orderstatus").schema
    _finish(
        stream_load(
            t.spark, f"{root}/in/o_orderstatus=*", "csv", schema, f"{root}/out", f"{root}/log",
            f"{root}/checkpoint", as_of=EVENTS,
        )
    )
    log = t.spark.read.parquet(f"{root}/log")
    folder = F.regexp_extract("file_name", "o_orderstatus=([A-Z])", 1)
    return log.groupBy(folder.alias("folder")).agg(
        F.sum("row_count").alias("row_count"),
        F.sum("row_parsed").alias("row_parsed"),
        F.sum("error_count").alias("error_count"),
    )


def _stream_alerts(t, key: str, config: str, usage: str, scope: str, top: str):
    """The alerts, with the last total of their window instead of the one that raised them."""
    root = scratch(t.spark, "alerts")
    for _ in range(2):  # the second run raises nothing again
        _finish(
            stream_quota_alerts(
                t.spark, t.stream(usage), lambda: t(config), key, scope, top,
                f"{root}/alerts", f"{root}/totals", f"{root}/checkpoint",
            )
        )
    days = day_totals(t.spark, f"{root}/totals", key, dt.date(1990, 1, 1))
    last = used_per_period(days, t(config), key).withColumnRenamed(key, "resource_name")
    alerts = read_batches(t.spark, f"{root}/alerts", QUOTA_ALERT).drop("credits_used")
    return rounded(alerts.join(last, ["resource_name", "window_start"]), 4, "credits_used")


@query(
    "stream_quota_alerts",
    "warehouse_metering_history event_quota_config",
    f"""SELECT * REPLACE ({R('credits_used', 4)} AS credits_used)
        FROM ({alerts_sql('WAREHOUSE', 'warehouse_name', 'event_quota_config', 'warehouse_metering_history', 'SUSPENDED', False)})""",
)
def _(t):
    return _stream_alerts(
        t, "warehouse_name", "event_quota_config", "warehouse_metering_history", "WAREHOUSE", WAREHOUSE_TOP
    )


@query(
    "stream_late_usage",
    "warehouse_metering_history event_quota_config",
    f"""SELECT * REPLACE ({R('credits_used', 4)} AS credits_used)
        FROM ({alerts_sql('WAREHOUSE', 'warehouse_name', 'event_quota_config', 'warehouse_metering_history', 'SUSPENDED', False)})""",
)
def _(t):
    """The second half of the log arrives first; what the stream drops of the first half is settled from the log."""
    root = scratch(t.spark, "late")
    usage = t("warehouse_metering_history")
    second = F.col("start_time") >= F.lit("2024-01-16").cast("timestamp_ntz")
    config, where = t("event_quota_config"), (f"{root}/alerts", f"{root}/totals", f"{root}/checkpoint")
    for half in (second, ~second):
        usage.where(half).write.mode("append").parquet(f"{root}/usage")
        arriving = t.spark.readStream.schema(usage.schema).parquet(f"{root}/usage")
        stream = stream_quota_alerts(t.spark, arriving, config, "warehouse_name", "WAREHOUSE", WAREHOUSE_TOP, *where)
        _finish(stream)
    dropped, watermark = late_rows(stream)
    if dropped:
        settle_late_usage(
            t.spark, t.spark.read.parquet(f"{root}/usage"), config, "warehouse_name", "WAREHOUSE", WAREHOUSE_TOP,
            *where, start=dt.datetime(2024, 1, 1), watermark=watermark,
        )
    days = day_totals(t.spark, f"{root}/totals", "warehouse_name", dt.date(1990, 1, 1))
    last = used_per_period(days, config, "warehouse_name").withColumnRenamed("warehouse_name", "resource_name")
    alerts = read_batches(t.spark, f"{root}/alerts", QUOTA_ALERT).drop("credits_used")
    return rounded(alerts.join(last, ["resource_name", "window_start"]), 4, "credits_used")


@query(
    "stream_service_alerts",
    "metering_history serverless_config",
    f"SELECT * REPLACE ({R('credits_used', 4)} AS credits_used) FROM ({SERVICE_ALERTS})",
)
def _(t):
    return _stream_alerts(t, "service_type", "serverless_config", "metering_history", "SERVERLESS", SERVICE_TOP)


@query(
    "stream_failed_login_alerts",
    "login_history",
    """
    SELECT client_ip, w AS window_start, count(*) AS failed_attempts
    FROM (SELECT client_ip, date_trunc('hour', event_timestamp) - h * INTERVAL 1 HOUR AS w
          FROM login_history, range(6) r(h) WHERE is_success = 'NO') GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(t):
    root = scratch(t.spark, "logins")
    _finish(
        stream_failed_login_alerts(
            t.spark, t.stream("login_history"), 2, f"{root}/alerts", f"{root}/checkpoint"
        )
    )
    return read_batches(t.spark, f"{root}/alerts", LOGIN_ALERT)


@query(
    "incremental_refresh",
    "",
    """SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max(event_id) AS event_id
       FROM events GROUP BY 1""",
)
def _(t):
    root = scratch(t.spark, "refresh")
    events = t.table("events").select("user_id", "event_type", "value", "event_id")
    file = F.lpad(F.col("event_id").cast("string"), 12, "0")
    landing_enrich(events, EVENTS, source_file=file).write.parquet(f"{root}/raw")
    schema = t.spark.read.parquet(f"{root}/raw").schema
    for _ in range(2):
        _finish(
            incremental_refresh(
                t.spark, f"{root}/raw", schema, f"{root}/out", f"{root}/checkpoint", ["user_id"], max_files=1
            )
        )
    return presented(t.spark, f"{root}/out", schema, ["user_id"]).drop(*TECHNICAL)


@query(
    "stream_load_two_sources",
    "",
    "SELECT o_orderkey AS key, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer",
)
def _(t):
    """Two streams with checkpoints of their own into one table."""
    root = scratch(t.spark, "two")
    sources = {"order": t.table("orders").select("o_orderkey"), "customer": t.table("customer").select("c_custkey")}
    for kind, rows in sources.items():
        named = rows.select(rows[0].cast("bigint").alias("key"), F.lit(kind).alias("kind"))
        named.write.json(f"{root}/in-{kind}")
        _finish(
            stream_load(
                t.spark, f"{root}/in-{kind}", "json", named.schema, f"{root}/out", f"{root}/log",
                f"{root}/checkpoint-{kind}", as_of=EVENTS,
            )
        )
    return t.spark.read.parquet(f"{root}/out").select("key", "kind")


@query(
    "compact_refresh",
    "",
    """SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max(event_id) AS event_id
       FROM events GROUP BY 1""",
)
def _(t):
    """Refresh, compact the closed batches, refresh again with changes only."""
    root = scratch(t.spark, "compact")
    events = t.table("events").select("user_id", "event_type", "value", "event_id")
    file = F.lpad(F.col("event_id").cast("string"), 12, "0")
    landed = landing_enrich(events, EVENTS, source_file=file)
    base = VersionedTable(t.spark, f"{root}/base")
    halves = [F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1]
    for half in halves:
        landed.where(half).write.mode("append").parquet(f"{root}/raw")
        _finish(
            incremental_refresh(
                t.spark, f"{root}/raw", landed.schema, f"{root}/out", f"{root}/checkpoint", ["user_id"],
                skip_unchanged=True, max_files=1, compacted=base,
            )
        )
        compact(t.spark, f"{root}/out", landed.schema, ["user_id"], base)
    return presented(t.spark, f"{root}/out", landed.schema, ["user_id"], base).drop(*TECHNICAL)
