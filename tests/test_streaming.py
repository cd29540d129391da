"""Streams: files seen once, restarts, replays, late and unordered input."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from gaugework.operators.landing import landing_enrich, unchanged_removed
from gaugework.operators.quota import WAREHOUSE_TOP
from gaugework.streaming.alerts import (
    LOGIN_ALERT,
    QUOTA_ALERT,
    day_totals,
    late_rows,
    settle_late_usage,
    stream_failed_login_alerts,
    stream_quota_alerts,
)
from gaugework.streaming.batches import read_batches, trigger, write_batch
from gaugework.streaming.load import EmptyFiles, incremental_refresh, presented, stream_load
from tests.conftest import by_key, ts

LANDED = "id long, note string"


def _load(spark, root):
    schema = spark.createDataFrame([], LANDED).schema
    q = stream_load(spark, f"{root}/in", "json", schema, f"{root}/out", f"{root}/log", f"{root}/ckpt", as_of="2024-01-01")
    q.awaitTermination()
    return q


def _file(root, name, *records):
    (root / "in").mkdir(exist_ok=True)
    (root / "in" / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def test_each_file_is_loaded_once(spark, tmp_path):
    _file(tmp_path, "a.json", {"id": 1, "note": "x"}, "{broken", {"id": 2})
    _load(spark, tmp_path)
    _load(spark, tmp_path)  # nothing new
    _file(tmp_path, "b.json", {"id": 3})
    _load(spark, tmp_path)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]
    assert {r._is_current for r in out.collect()} == {True}
    log = {r.file_name.rsplit("/", 1)[1]: (r.row_count, r.error_count, r.status) for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert log == {"a.json": (2, 1, "PARTIAL"), "b.json": (1, 0, "LOADED")}


def test_a_repeated_batch_overwrites_itself(spark, frame, tmp_path):
    df = frame(LANDED, [(1, "x")])
    for _ in range(2):
        write_batch(df, f"{tmp_path}/t", "s", 0)
    write_batch(df, f"{tmp_path}/t", "s", 1)
    write_batch(df, f"{tmp_path}/t", "other", 0)
    assert read_batches(spark, f"{tmp_path}/t", df.schema).count() == 3
    assert read_batches(spark, f"{tmp_path}/t", df.schema, exclude=("s", 1)).count() == 2
    assert read_batches(spark, f"{tmp_path}/none", df.schema).count() == 0


USAGE = "warehouse_name string, start_time timestamp_ntz, credits_used double"


DAILY = (("W", "DAILY", 100.0, True), ("V", "DAILY", 50.0, True))


def _alerts(spark, frame, root, quotas=DAILY):
    usage = spark.readStream.schema(frame(USAGE, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/usage")
    config = frame("warehouse_name string, frequency string, credit_limit double, is_active boolean", quotas)
    q = stream_quota_alerts(
        spark, usage, lambda: config, "warehouse_name", "WAREHOUSE", WAREHOUSE_TOP, f"{root}/alerts", f"{root}/totals", f"{root}/ckpt"
    )
    q.awaitTermination()
    got = read_batches(spark, f"{root}/alerts", QUOTA_ALERT).collect()
    return sorted((r.resource_name, r.window_start.day, r.threshold_pct) for r in got), q


def _usage(frame, root, *data):
    frame(USAGE, [(w, ts(t), c) for w, t, c in data]).coalesce(1).write.mode("append").parquet(f"{root}/usage")


def test_thresholds_alert_once_as_usage_grows(spark, frame, tmp_path):
    _usage(frame, tmp_path, ("W", "2024-01-02 01:00:00", 69.9), ("V", "2024-01-02 01:00:00", 10.0))
    assert _alerts(spark, frame, tmp_path)[0] == []
    _usage(frame, tmp_path, ("W", "2024-01-02 02:00:00", 16.0))
    first, _ = _alerts(spark, frame, tmp_path)
    assert first == [("W", 2, 70.0), ("W", 2, 85.0)]
    _usage(frame, tmp_path, ("W", "2024-01-02 03:00:00", 1.0), ("V", "2024-01-02 23:59:59", 40.0))
    second, _ = _alerts(spark, frame, tmp_path)
    assert second == [("V", 2, t) for t in (70.0, 85.0, 95.0, 100.0)] + first
    # A new day starts from nothing; an hour late is still in time.
    _usage(frame, tmp_path, ("W", "2024-01-03 00:00:00", 70.0))
    _usage(frame, tmp_path, ("W", "2024-01-02 23:00:00", 10.0))
    third, _ = _alerts(spark, frame, tmp_path)
    assert set(third) - set(second) == {("W", 3, 70.0), ("W", 2, 95.0)}
    again, _ = _alerts(spark, frame, tmp_path)
    assert again == third


def test_periods_of_other_frequencies(spark, frame, tmp_path):
    quotas = [("W", "MONTHLY", 10.0, True), ("V", "NEVER", 1.0, True), ("X", "WEEKLY", 10.0, True)]
    _usage(frame, tmp_path, ("W", "2024-01-02 01:00:00", 6.0), ("V", "2024-01-02 01:00:00", 9.0), ("X", "2024-01-07 01:00:00", 6.0))
    assert _alerts(spark, frame, tmp_path, quotas)[0] == []
    _usage(frame, tmp_path, ("W", "2024-01-08 01:00:00", 6.0), ("X", "2024-01-08 01:00:00", 6.0))
    got, _ = _alerts(spark, frame, tmp_path, quotas)
    assert got == [("W", 1, t) for t in (70.0, 85.0, 95.0, 100.0)]
    # An edited quota counts from the next batch on.
    _usage(frame, tmp_path, ("X", "2024-01-08 02:00:00", 1.0))
    got, _ = _alerts(spark, frame, tmp_path, [("X", "WEEKLY", 10.0, True)])
    assert [g for g in got if g[0] == "X"] == [("X", 8, 70.0)]


def test_two_streams_and_a_replaced_checkpoint_keep_all_rows(spark, tmp_path):
    _file(tmp_path, "a.json", {"id": 1})
    _load(spark, tmp_path)
    schema = spark.createDataFrame([], LANDED).schema
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "b.json").write_text('{"id": 2}\n')
    stream_load(
        spark, f"{tmp_path}/in2", "json", schema, f"{tmp_path}/out", f"{tmp_path}/log", f"{tmp_path}/ckpt2", as_of="2024-01-01"
    ).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_empty_files_are_logged_once(spark, tmp_path):
    _file(tmp_path, "a.json", {"id": 1})
    (tmp_path / "in" / "empty.json").write_text("")
    _load(spark, tmp_path)
    _file(tmp_path, "b.json", {"id": 2})
    _load(spark, tmp_path)
    log = [(r.file_name.rsplit("/", 1)[1], r.row_parsed, r.status) for r in spark.read.parquet(f"{tmp_path}/log").collect()]
    assert sorted(log) == [("a.json", 1, "LOADED"), ("b.json", 1, "LOADED"), ("empty.json", 0, "LOADED")]


def test_rows_past_the_watermark_are_dropped_and_counted(spark, frame, tmp_path):
    _usage(frame, tmp_path, ("W", "2024-01-02 01:00:00", 1.0))
    _usage(frame, tmp_path, ("W", "2024-01-09 01:00:00", 1.0))
    _alerts(spark, frame, tmp_path)
    _usage(frame, tmp_path, ("W", "2024-01-02 02:00:00", 500.0))
    got, q = _alerts(spark, frame, tmp_path)
    assert got == []
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    assert dropped == 1


def test_a_correction_lowers_the_day(spark, frame, tmp_path):
    quotas = [("W", "WEEKLY", 100.0, True)]
    _usage(frame, tmp_path, ("W", "2024-01-02 01:00:00", 60.0))
    _alerts(spark, frame, tmp_path, quotas)
    _usage(frame, tmp_path, ("W", "2024-01-02 02:00:00", -40.0))
    _alerts(spark, frame, tmp_path, quotas)
    days = day_totals(spark, f"{tmp_path}/totals", "warehouse_name", dt.date(2024, 1, 1))
    assert [(r.day.day, r.credits_used) for r in days.collect()] == [(2, 20.0)]
    _usage(frame, tmp_path, ("W", "2024-01-03 01:00:00", 45.0))
    assert _alerts(spark, frame, tmp_path, quotas)[0] == []


def test_late_usage_is_settled_from_the_log(spark, frame, tmp_path):
    quotas = [("W", "WEEKLY", 100.0, True)]
    _usage(frame, tmp_path, ("W", "2024-01-02 01:00:00", 30.0), ("W", "2024-01-03 01:00:00", 30.0))
    _usage(frame, tmp_path, ("W", "2024-01-12 01:00:00", 1.0))
    _alerts(spark, frame, tmp_path, quotas)
    _usage(frame, tmp_path, ("W", "2024-01-02 02:00:00", 20.0), ("V", "2024-01-02 02:00:00", 5.0))
    got, q = _alerts(spark, frame, tmp_path, quotas)
    dropped, watermark = late_rows(q)
    assert got == [] and dropped == 2 and watermark == dt.datetime(2024, 1, 11, 1)
    config = frame("warehouse_name string, frequency string, credit_limit double, is_active boolean", quotas)

    def settle():
        usage = spark.read.parquet(f"{tmp_path}/usage")
        settle_late_usage(
            spark, usage, config, "warehouse_name", "WAREHOUSE", WAREHOUSE_TOP, f"{tmp_path}/alerts", f"{tmp_path}/totals",
            f"{tmp_path}/ckpt", start=dt.datetime(2024, 1, 1), watermark=watermark,
        )
        days = day_totals(spark, f"{tmp_path}/totals", "warehouse_name", dt.date(2024, 1, 1)).collect()
        log = read_batches(spark, f"{tmp_path}/alerts", QUOTA_ALERT).collect()
        return {(r.warehouse_name, r.day.day): r.credits_used for r in days}, sorted(r.threshold_pct for r in log)

    first = settle()
    assert first == ({("W", 2): 50.0, ("W", 3): 30.0, ("W", 12): 1.0, ("V", 2): 5.0}, [70.0])
    # Settling again changes nothing; later usage of the same day lowers or raises it once more.
    assert settle() == first
    _usage(frame, tmp_path, ("W", "2024-01-02 03:00:00", 25.0), ("W", "2024-01-03 03:00:00", -5.0))
    assert settle() == ({("W", 2): 75.0, ("W", 3): 25.0, ("W", 12): 1.0, ("V", 2): 5.0}, [70.0, 85.0, 95.0, 100.0])


def test_empty_files_are_looked_for_among_new_files_only(spark, tmp_path):
    old = time.time() - 3600
    (tmp_path / "in").mkdir()
    for name in ("a.json", "b.json"):
        (tmp_path / "in" / name).write_text("")
        os.utime(tmp_path / "in" / name, (old, old))
    empty = EmptyFiles(spark, f"{tmp_path}/in", f"{tmp_path}/log")

    def look():
        return sorted(r.file_name.rsplit("/", 1)[1] for r in empty.unlogged().collect())

    assert look() == ["a.json", "b.json"]
    (tmp_path / "in" / "c.json").write_text("")
    (tmp_path / "in" / "d.json").write_text("{}")
    # Too old for the second look: not listed any more.
    (tmp_path / "in" / "old.json").write_text("")
    os.utime(tmp_path / "in" / "old.json", (old, old))
    assert look() == ["c.json"]
    assert look() == []


def test_sliding_login_windows(spark, frame, tmp_path):
    schema = "client_ip string, event_timestamp timestamp_ntz, is_success string"
    data = [("ip", ts(f"2024-01-01 0{h}:30:00"), "NO") for h in (1, 4, 8)] + [("ip", ts("2024-01-01 05:00:00"), "YES")]
    frame(schema, data).write.parquet(f"{tmp_path}/logins")
    logins = spark.readStream.schema(frame(schema, []).schema).parquet(f"{tmp_path}/logins")
    stream_failed_login_alerts(spark, logins, 2, f"{tmp_path}/alerts", f"{tmp_path}/ckpt").awaitTermination()
    got = by_key(read_batches(spark, f"{tmp_path}/alerts", LOGIN_ALERT), "window_start", "failed_attempts")
    assert got == {ts("2023-12-31 23:00:00"): 2, ts("2024-01-01 00:00:00"): 2, ts("2024-01-01 01:00:00"): 2,
                   ts("2024-01-01 03:00:00"): 2, ts("2024-01-01 04:00:00"): 2}


VERSION = "k string, v long, _loaded_at timestamp_ntz, _source_file string, _row_hash string, _is_current boolean"


@pytest.mark.parametrize("skip_unchanged", [False, True])
def test_refresh_presents_the_newest_rows(spark, frame, tmp_path, skip_unchanged):
    schema = frame(VERSION, []).schema

    def run(*data):
        frame(VERSION, [(k, v, ts(f"2024-01-0{d}"), "f", f"h{v}", c) for k, v, d, c in data]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        incremental_refresh(
            spark, f"{tmp_path}/raw", schema, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["k"], skip_unchanged=skip_unchanged
        ).awaitTermination()
        return by_key(presented(spark, f"{tmp_path}/out", schema, ["k"]), "k", "v")

    assert run(("a", 1, 1, True), ("b", 1, 1, True), ("c", 9, 1, False)) == {"a": 1, "b": 1}
    assert run(("a", 2, 2, True), ("b", 1, 2, True)) == {"a": 2, "b": 1}
    stored = read_batches(spark, f"{tmp_path}/out", schema).count()
    assert stored == (3 if skip_unchanged else 4)


def test_stored_keys_are_not_sent_to_the_driver(spark, frame):
    schema = "id long, v string"
    stored = landing_enrich(frame(schema, [(1, "a"), (None, "n"), (2, "b")]), "2024-01-01", F.lit("f1"))
    batch = landing_enrich(frame(schema, [(1, "a"), (None, "n"), (2, "c"), (3, None)]), "2024-01-02", F.lit("f2"))
    fresh = unchanged_removed(batch, stored, ["id"])
    assert {(r["id"], r["v"]) for r in fresh.collect()} == {(2, "c"), (3, None)}
    assert "Broadcast" not in fresh._jdf.queryExecution().executedPlan().toString()


def test_cadences():
    assert trigger(None) == {"availableNow": True}
    assert trigger("5 minutes") == {"processingTime": "5 minutes"}
    with pytest.raises(ValueError):
        trigger("2 weeks")
