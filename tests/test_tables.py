"""Control-table writes, landing versions, files and sinks."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaugework import schemas
from gaugework.operators import control, landing
from gaugework.operators.filters import period_filter
from gaugework.sources import UsageCatalog, VersionedTable, clustered, load_files, write_usage_log
from gaugework.sources.catalog import scan_usage
from tests.conftest import rows, ts

TARGET = "k string, v string, created string, updated string"


# ---- upserts --------------------------------------------------------------------------


def test_upsert(frame):
    target = frame(TARGET, [("a", "1", "c0", "u0"), ("b", "2", "c0", "u0")])
    source = frame("k string, v string", [("a", None), ("n", "9")])
    out = control.upsert(target, source, ["k"], ["v"], {"created": "now", "updated": "now"}, {"updated": "now"})
    want = [("a", None, "c0", "now"), ("b", "2", "c0", "u0"), ("n", "9", "now", "now")]
    assert sorted(rows(out), key=str) == sorted(want, key=str)
    again = control.upsert(out, source, ["k"], ["v"], {"created": "later"}, {"updated": "now"})
    assert sorted(rows(again), key=str) == sorted(want, key=str)


def test_upsert_refuses_duplicate_keys(frame):
    target = frame(TARGET, [])
    twice = frame("k string, v string", [("a", "1"), ("a", "2")])
    with pytest.raises(Exception, match="duplicate source key"):
        control.upsert(target, twice, ["k"], ["v"]).collect()
    with pytest.raises(Exception, match="duplicate source key"):
        control.insert_if_absent(target, twice, ["k"]).collect()


def test_insert_if_absent_keeps_stored_rows(frame):
    target = frame(TARGET, [("a", "1", "c", "u")])
    source = frame("k string, v string", [("a", "changed"), ("b", "2")])
    out = control.insert_if_absent(target, source, ["k"], {"created": "now"})
    assert sorted(rows(out), key=str) == [("a", "1", "c", "u"), ("b", "2", "now", None)]


def test_update_where_ignores_unknown(frame):
    df = frame("k string, v long", [("a", 1), ("b", None)])
    out = control.update_where(df, F.col("v") > 0, {"k": "hit"})
    assert rows(out) == [("hit", 1), ("b", None)]


def test_append_log_ids_continue_without_gaps(spark, frame, tmp_path):
    log = spark.createDataFrame([(41, ts("2024-01-01"), "A", "x", "T", "n", "SUCCESS", "{}")], schemas.CONTROL_SCHEMAS["audit_log"])
    # 64 partitions of very different sizes, some of them empty.
    events = spark.range(1000).repartitionByRange(64, (F.col("id") / 300).cast("int")).select(
        F.lit("CREATE").alias("event_type"), F.concat(F.lit("o"), "id").alias("object_name"), F.lit(7).alias("log_id")
    )
    args = ("log_id", "event_time", "2024-02-01")
    added = control.append_log(log, events, *args, actor="me", path=str(tmp_path / "a"))
    assert added.schema.fieldNames() == log.schema.fieldNames()
    first = {r.object_name: r.log_id for r in added.collect()}
    assert sorted(first.values()) == list(range(42, 1042))
    # Read again with another split: the same rows keep the same ids.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert {r.object_name: r.log_id for r in added.collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ordered = control.append_log(log.limit(0), events, *args, order=("object_name",), path=str(tmp_path / "b")).collect()
    assert [r.log_id for r in sorted(ordered, key=lambda r: r.object_name)] == list(range(1, 1001))
    assert control.append_log(log, events.limit(0), *args, path=str(tmp_path / "c")).count() == 0


def test_versioned_table(spark, frame, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.current_version() is None
    with pytest.raises(ValueError):
        table.read()
    table.write(frame("k long", [(1,)]))
    table.write(table.read().unionByName(frame("k long", [(2,)])))
    assert sorted(r.k for r in table.read().collect()) == [1, 2]
    assert [r.k for r in table.read(0).collect()] == [1]
    # Data of a version that was never committed stays invisible and is replaced.
    frame("k long", [(99,)]).write.parquet(str(tmp_path / "t/data/v00000002"))
    assert table.current_version() == 1
    table.write(frame("k long", [(3,)]))
    assert [r.k for r in table.read().collect()] == [3]


def test_control_schemas_are_complete():
    assert set(schemas.CONTROL_KEYS) == set(schemas.CONTROL_SCHEMAS)
    for name, keys in schemas.CONTROL_KEYS.items():
        assert set(keys) <= set(schemas.CONTROL_SCHEMAS[name].fieldNames())
    for name, defaults in schemas.CONTROL_DEFAULTS.items():
        assert set(defaults) <= set(schemas.CONTROL_SCHEMAS[name].fieldNames())


def test_defaults_fill_new_rows(spark, frame):
    empty = spark.createDataFrame([], schemas.CONTROL_SCHEMAS["warehouse_config"])
    added = control.insert_if_absent(
        empty, frame("warehouse_name string", [("W",)]), ["warehouse_name"], schemas.CONTROL_DEFAULTS["warehouse_config"]
    ).first()
    assert (added.frequency, added.credit_limit, added.is_active) == ("DAILY", Decimal("100.0000"), True)


def _control(spark, name, **values):
    schema = schemas.CONTROL_SCHEMAS[name]
    return spark.createDataFrame([tuple(values.get(f) for f in schema.fieldNames())], schema)


def test_a_changed_connection_is_pending_again(spark, frame):
    stored = _control(spark, "external_connections", connection_name="GIT", connection_type="GIT", status="CONNECTED", last_test_msg="ok", created_at=ts("2023-01-01"))
    edits = frame("connection_name string, connection_type string, endpoint_url string, account_id string, secret_ref string", [("GIT", "GIT", "https://x", "a", "s"), ("NEW", "GIT", None, None, None)])
    out = {r.connection_name: r for r in control.write_control("external_connections", stored, edits, "2024-01-01").collect()}
    assert (out["GIT"].status, out["GIT"].endpoint_url, out["GIT"].created_at, out["GIT"].updated_at) == ("PENDING", "https://x", ts("2023-01-01"), ts("2024-01-01"))
    assert (out["NEW"].status, out["NEW"].created_at) == ("PENDING", ts("2024-01-01"))
    tested = control.record_connection_test(stored, "GIT", "ERROR", "HTTP 500", "2024-01-02").first()
    assert (tested.status, tested.last_test_at, tested.last_test_msg) == ("ERROR", ts("2024-01-02"), "HTTP 500")


def test_projects_keep_their_status(spark, frame):
    stored = _control(spark, "projects", project_id="P", project_name="old", status="INACTIVE", created_at=ts("2023-01-01"))
    edits = frame("project_id string, project_name string, description string, dsi_db string, dso_db string, wh_size string", [("P", "new", None, "a", "b", "LARGE"), ("Q", "q", None, "a", "b", "SMALL")])
    out = {r.project_id: r for r in control.write_control("projects", stored, edits, "2024-01-01").collect()}
    assert (out["P"].status, out["P"].project_name, out["P"].created_at) == ("INACTIVE", "new", ts("2023-01-01"))
    assert out["Q"].status == "ACTIVE"
    assert {r.status for r in control.deactivate_project(control.write_control("projects", stored, edits, "2024-01-01"), "Q").collect()} == {"INACTIVE"}


def test_connectors_wait_until_they_have_an_id(spark, frame):
    empty = spark.createDataFrame([], schemas.CONTROL_SCHEMAS["connectors"])
    asked = frame("project_id string, connector_name string", [("P", "my crm")]).withColumn("connector_key", control.entry_key("project_id", "connector_name"))
    pending = control.register_pending("connectors", empty, asked, "2024-01-01")
    row = pending.first()
    assert (row.connector_key, row.status, row.paused) == ("P_MY_CRM", "PENDING", False)
    assert control.register_pending("connectors", pending, asked, "2024-01-02").first().created_at == ts("2024-01-01")
    answered = asked.withColumn("external_connector_id", F.lit("ext-1"))
    row = control.write_control("connectors", pending, answered, "2024-01-03").first()
    assert (row.status, row.external_connector_id, row.created_at, row.updated_at) == ("ACTIVE", "ext-1", ts("2024-01-01"), ts("2024-01-03"))


def test_seeding_twice_changes_nothing(spark):
    empty = spark.createDataFrame([], schemas.CONTROL_SCHEMAS["naming_convention"])
    once = control.seed_naming(empty, "2024-01-01")
    assert {(r.layer_code, r.prefix, r.separator, r.enabled) for r in once.collect()} == {
        (layer, prefix, "_", True) for layer, prefix in control.NAMING_SEED
    }
    assert rows(control.seed_naming(once, "2024-02-01").orderBy("layer_code")) == rows(once.orderBy("layer_code"))


def test_quota_edits_are_saved_by_warehouse(spark, frame):
    from gaugework.operators import users

    stored = _control(spark, "warehouse_config", warehouse_name="W", credit_limit=Decimal(5), frequency="DAILY", is_active=True)
    edited = stored.withColumn("credit_limit", F.lit(7.9).cast("decimal(18,4)"))
    accepted = users.accepted_changes(users.config_changes(edited, stored))
    assert control.save_quota_config(stored, accepted).first().credit_limit == Decimal(7)


# ---- landing ----------------------------------------------------------------------------


def test_row_hash_covers_the_whole_row(frame):
    long = "x" * 100_000
    df = frame("a string, b string", [(long + "1", "z"), (long + "2", "z"), (None, "z"), ("", "z"), ("z", None)])
    hashes = [r._row_hash for r in landing.landing_enrich(df, "2024-01-01").collect()]
    assert len(set(hashes)) == 5 and {len(h) for h in hashes} == {64}


def test_row_hash_sees_microseconds(frame):
    df = frame("t timestamp_ntz", [(ts("2024-01-01 00:00:00.000001"),), (ts("2024-01-01 00:00:00.000002"),)])
    assert landing.landing_enrich(df, "2024-01-01").select("_row_hash").distinct().count() == 2


def _version(key, value, day, file="f"):
    return (key, value, ts(f"2024-01-{day:02d}"), file, f"h{value}", True)


VERSION = "k string, v long, _loaded_at timestamp_ntz, _source_file string, _row_hash string, _is_current boolean"


def test_exactly_one_current_row_per_key(frame):
    data = [_version("a", 1, 1), _version("a", 2, 2), _version("a", 3, 2, "g"), _version("a", 4, 2, "g"), _version("b", 1, 1)]
    data += [_version("hot", 1, 3)] * 500 + [_version(None, 1, 1), _version(None, 2, 2)]
    out = landing.mark_current(frame(VERSION, data), ["k"])
    current = {r.k: r.v for r in landing.current_rows(out).collect()}
    assert current == {"a": 4, "b": 1, "hot": 1, None: 2}
    assert landing.current_rows(out).count() == 4
    assert out.count() == 8  # the 500 copies are one version
    latest = {r.k: r.v for r in landing.latest_versions(frame(VERSION, data), ["k"]).collect()}
    assert latest == current


def test_a_returning_value_is_a_new_version_and_a_repeat_is_not(frame):
    stored = landing.mark_current(frame(VERSION, [_version("a", 1, 1), _version("a", 2, 2)]), ["k"])
    same = landing.append_versions(stored, frame(VERSION, [_version("a", 2, 3)]), ["k"])
    assert same.count() == 2
    back = landing.append_versions(stored, frame(VERSION, [_version("a", 1, 3)]), ["k"])
    assert back.count() == 3
    assert [(r.v, r._loaded_at.day) for r in landing.current_rows(back).collect()] == [(1, 3)]


def test_landing_schema_limits():
    assert schemas.landing_schema({"ID": "NUMBER(18,0)", "DOC": "VARIANT"}).fieldNames() == ["ID", "DOC"]
    with pytest.raises(ValueError):
        schemas.landing_schema({})
    assert len(schemas.landing_schema({f"C{i}": "DATE" for i in range(50)})) == 50


# ---- files --------------------------------------------------------------------------------


def test_csv_with_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines, ""quoted"""\nx,bad\n3,\n')
    (tmp_path / "b.csv").write_text("id,note\ny,bad\n")
    loaded = load_files(spark, str(tmp_path), "CSV", spark.createDataFrame([], "id long, note string").schema, {"multiLine": "true"}, keep_corrupt=True).persist()
    good = loaded.where("_corrupt_record IS NULL").orderBy("id")
    assert [(r.id, r.note) for r in good.collect()] == [(1, 'two\nlines, "quoted"'), (3, None)]
    log = {r.file_name.rsplit("/", 1)[1]: r for r in landing.load_log(loaded, "2024-01-01").collect()}
    assert (log["a.csv"].row_count, log["a.csv"].row_parsed, log["a.csv"].error_count, log["a.csv"].status) == (2, 3, 1, "PARTIAL")
    assert log["b.csv"].status == "LOAD_FAILED"


def test_bad_records_fail_a_load_that_does_not_keep_them(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\nnot json\n')
    schema = spark.createDataFrame([], "id long").schema
    with pytest.raises(Exception, match="MALFORMED"):
        load_files(spark, str(tmp_path), "json", schema).collect()
    kept = load_files(spark, str(tmp_path), "json", schema, keep_corrupt=True).collect()
    assert sorted((r.id or 0, r._corrupt_record) for r in kept) == [(0, "not json"), (1, None)]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        load_files(spark, "/nowhere", "xml", None)


def test_avro_needs_its_package(spark, tmp_path):
    try:
        spark.range(1).write.format("avro").save(str(tmp_path / "x"))
    except AnalysisException:
        pytest.skip("spark-avro is not on the classpath")
    schema = spark.range(1).schema
    assert load_files(spark, str(tmp_path / "x"), "avro", schema).count() == 1


def test_variant_landing_column(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ID": 1, "DOC": {"k": [1, 2]}}\n')
    schema = schemas.landing_schema({"ID": "NUMBER(18,0)", "DOC": "VARIANT"})
    row = load_files(spark, str(tmp_path), "json", schema).select(F.variant_get("DOC", "$.k[1]", "int").alias("x")).first()
    assert row.x == 2


# ---- sinks and scans ---------------------------------------------------------------------------


def test_hot_value_spreads_over_tasks(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), F.col("id").alias("payload")
    )
    laid_out = clustered(df, "key", 12)
    parts = laid_out.select("key", F.spark_partition_id().alias("p"))
    assert parts.where("key = -1").select("p").distinct().count() >= 3
    assert laid_out.count() == 20_000
    bounds = [(r.lo, r.hi) for r in parts.groupBy("p").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo", "hi").collect()]
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def _metering(frame, days=10):
    return frame(
        "warehouse_name string, start_time timestamp_ntz, end_time timestamp_ntz, credits_used double, credits_used_compute double, credits_used_cloud_services double",
        [("W", ts("2024-01-01") + dt.timedelta(days=d), ts("2024-01-01") + dt.timedelta(days=d), 1.0, 0.9, 0.1) for d in range(days)],
    )


def test_period_prunes_date_folders(spark, frame, tmp_path):
    root = str(tmp_path)
    write_usage_log(_metering(frame), f"{root}/warehouse_metering_history", "start_time")
    log = UsageCatalog(spark, root).table("warehouse_metering_history")
    kept = period_filter(log, "start_time", "2024-01-03 06:00:00", "2024-01-05 12:00:00")
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_time_date" in plan
    # The folders say nothing about another time column.
    other = period_filter(log, "end_time", "2024-01-03 06:00:00", "2024-01-05 12:00:00")
    assert "PartitionFilters: []" in other._jdf.queryExecution().executedPlan().toString()


def test_scan_normalises_types_and_refuses_missing_columns(spark, frame, tmp_path):
    root = str(tmp_path)
    users = frame(
        "name string, email string, default_role string, has_password string, has_rsa_public_key boolean, ext_authn_duo string, has_mfa boolean, disabled string, last_success_login timestamp, deleted_on timestamp_ntz",
        [("a", "e", "r", "true", True, "false", None, "maybe", ts("2024-01-01 10:00:00"), None)],
    )
    users.write.parquet(f"{root}/users")
    row = scan_usage(spark, root, "users").first()
    assert (row.has_password, row.ext_authn_duo, row.disabled) == (True, False, None)
    assert dict(scan_usage(spark, root, "users").dtypes)["last_success_login"] == "timestamp_ntz"
    users.drop("disabled").write.parquet(f"{root}/bad/users")
    with pytest.raises(ValueError, match="disabled"):
        scan_usage(spark, f"{root}/bad", "users")
    with pytest.raises(KeyError):
        scan_usage(spark, root, "nope")


def test_documents_in_logs(spark, frame):
    log = frame(
        "log_id long, event_time timestamp_ntz, details string",
        [
            (1, ts("2024-01-01"), '{"a": {"b": 1}, "k": "x"}'),
            (2, ts("2024-01-02"), '{"k":"x","a":{"b":"1"}}'),
            (3, ts("2024-01-03"), "{broken"),
            (4, ts("2024-01-04"), None),
            (5, ts("2024-01-05"), '{"a": null}'),
        ],
    )
    assert [r.log_id for r in control.audit_by_detail(log, "$.k", "x").collect()] == [2, 1]
    # A text that reads as a number counts as one.
    assert sorted(r.log_id for r in control.audit_by_detail(log, "$.a.b", 1, "int").collect()) == [1, 2]
    assert control.audit_by_detail(log, "$.z", "x").count() == 0
    schema = control.document_schema(log, "details").first().schema
    assert "OBJECT" in schema and "k: STRING" in schema
    texts = log.where("log_id in (1, 5)").select(control.document("details").alias("d")).collect()
    assert [r.d for r in texts] == ['{"a":{"b":1},"k":"x"}', '{"a":null}']
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        log.select(control.document("details")).collect()
    assert control.document_schema(log.limit(0), "details").count() == 1
