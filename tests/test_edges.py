"""Rule boundaries on small literal tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugework.functions import add_months, preset, round_to, trunc_to
from gaugework.operators import control, cost, filters, governance, performance, quota, security, sizing, users
from tests.conftest import by_key, rows, ts

NOW = "2024-03-31 12:00:00"


# ---- time ------------------------------------------------------------------------------


def test_months_clip_to_the_last_day():
    assert add_months("2024-03-31", -1) == ts("2024-02-29")
    assert add_months("2024-01-31", 1) == ts("2024-02-29")
    assert add_months("2024-01-15 08:00:00", -12) == ts("2023-01-15 08:00:00")


def test_presets():
    assert preset("last_hour", "2024-01-30 00:30:00") == (ts("2024-01-29 23:30:00"), ts("2024-01-30 00:30:00"))
    assert preset("last_7d", "2024-01-30 10:00:00") == (ts("2024-01-23"), ts("2024-01-30 23:59:00"))
    assert preset("last_30d", "2024-01-30 10:00:00", whole_day=True)[1] == ts("2024-01-30 23:59:59")


def test_period_is_inclusive_and_cut_to_seconds(frame):
    df = frame(
        "t timestamp_ntz",
        [(ts("2024-01-01 00:00:00"),), (ts("2024-01-01 00:00:10"),), (ts("2024-01-01 00:00:10.5"),)],
    )
    kept = filters.period_filter(df, "t", "2024-01-01 00:00:00.900", "2024-01-01 00:00:10.999")
    assert kept.count() == 2


def test_truncation_keeps_wall_clock(frame):
    df = frame("t timestamp_ntz", [(ts("2024-03-31 02:30:45.5"),)])
    row = df.select(*[trunc_to("t", g).alias(g) for g in ("hour", "day", "month")]).first()
    assert tuple(row) == (ts("2024-03-31 02:00:00"), ts("2024-03-31"), ts("2024-03-01"))


def test_lookback_on_dates(frame):
    df = frame("d date", [(dt.date(2024, 3, d),) for d in (1, 2, 3)])
    assert filters.lookback(df, "d", 29, "day", NOW).count() == 1  # 2 March 12:00: the 2nd is before it
    assert filters.lookback(df, "d", 29, "day", NOW, from_midnight=True).count() == 2


def test_rounding_follows_the_decimal_value(frame):
    df = frame("a double, b double", [(12.75, 20.0), (0.575, 1.0), (-12.75, 20.0), (None, 1.0)])
    out = df.select(round_to(F.col("a") / F.col("b") * 100, 1).alias("r"))
    assert [r.r for r in out.collect()] == [63.8, 57.5, -63.8, None]


# ---- filters -------------------------------------------------------------------------------


def test_lists_and_facets(frame):
    df = frame("a string, b string", [("x", "1"), ("", "2"), (None, "3"), ("y'z", "4")])
    assert filters.in_list(df, "a", []).count() == 4
    assert [r.b for r in filters.in_list(df, "a", [None, "y'z"]).orderBy("b").collect()] == ["2", "4"]
    assert filters.optional_filters(df, a="x", b=None).count() == 1
    assert filters.optional_filters(df, a="Tous").count() == 0
    assert filters.optional_filters(df, a=None, b=None).count() == 4
    assert filters.facet_filter(df, a=["x", ""], b=["1"]).count() == 1
    assert filters.facet_filter(df, a=[]).count() == 0
    assert rows(filters.distinct_values(df, "a")) == [("",), ("x",), ("y'z",)]


# ---- cost ------------------------------------------------------------------------------------


def test_month_over_month_without_a_previous_month(frame):
    schema = "service_type string, start_time timestamp_ntz, credits_used double"
    only_now = frame(schema, [("A", ts("2024-03-05"), 10.0)])
    row = cost.credits_month_over_month(only_now, NOW).first()
    assert (row.credits_this_month, row.credits_last_month, row.credits_7d, row.delta_pct) == (10.0, 0.0, 0.0, None)
    both = frame(schema, [("A", ts("2024-03-30"), 15.0), ("A", ts("2024-02-29 23:59:59"), 10.0), ("A", ts("2024-01-31"), 99.0)])
    row = cost.credits_month_over_month(both, NOW).first()
    assert (row.credits_this_month, row.credits_last_month, row.credits_7d, row.delta_pct) == (15.0, 10.0, 15.0, 50.0)


def test_category_split_is_empty_without_usage(frame):
    kpis = frame("warehouse_credits double, serverless_credits double, total_credits double", [(0.0, 0.0, 0.0)])
    assert cost.category_split(kpis).count() == 0


def test_warehouse_cost_is_rounded_once(frame):
    wm = frame("warehouse_name string, start_time timestamp_ntz, credits_used double", [("W", ts("2024-01-01"), 1.114)])
    assert cost.warehouse_cost(wm, "2024-01-01", "2024-01-02").first().estimated_cost_usd == 4.46


def test_share_of_nothing(frame):
    mt = frame("service_type string, start_time timestamp_ntz, credits_used double", [("A", ts("2024-03-30"), 0.0)])
    assert rows(cost.service_share_pct(mt, NOW)) == [("A", 0.0, None)]


# ---- quotas -------------------------------------------------------------------------------------

CONFIG = "warehouse_name string, frequency string, credit_limit decimal(18,4), auto_suspend_at_100 boolean, alert_emails array<string>, is_active boolean"
METERING = "warehouse_name string, start_time timestamp_ntz, end_time timestamp_ntz, credits_used double"


def _config(*limits):
    return [(name, freq, Decimal(limit), False, mails, active) for name, freq, limit, mails, active in limits]


def test_quota_bands(frame):
    config = frame(
        CONFIG,
        _config(
            ("at70", "DAILY", 100, ["a", "b"], True),
            ("at85", "DAILY", 100, None, True),
            ("at95", "DAILY", 100, [], True),
            ("at100", "DAILY", 100, ["a", None], True),
            ("below", "DAILY", 100, ["a"], True),
            ("zero", "DAILY", 0, ["a"], True),
            ("idle", "DAILY", 10, ["a"], True),
            ("off", "DAILY", 10, ["a"], False),
        ),
    )
    today, end = ts("2024-03-31 01:00:00"), ts("2024-03-31 02:00:00")
    used = {"at70": 70.0, "at85": 85.0, "at95": 95.0, "at100": 100.0, "below": 69.999, "zero": 5.0, "off": 99.0}
    data = [(k, today, end, v) for k, v in used.items()] + [("idle", ts("2024-03-30 23:59:59"), end, 50.0)]
    status = quota.quota_status(config, frame(METERING, data), "warehouse_name", quota.WAREHOUSE_TOP, NOW)
    assert by_key(status, "warehouse_name", "status") == {
        "at70": "MONITORING",
        "at85": "ACTION_REQUIRED",
        "at95": "CRITICAL",
        "at100": "SUSPENDED",
        "below": "OK",  # although it shows as 70.0 %
        "zero": "NO_LIMIT",
        "idle": "OK",
    }
    assert by_key(status, "warehouse_name", "pct_used")["below"] == 70.0
    assert by_key(status, "warehouse_name", "pct_used")["zero"] is None
    assert by_key(status, "warehouse_name", "alert_recipients")["at70"] == "a, b"
    assert by_key(status, "warehouse_name", "alert_recipients")["at85"] is None
    assert by_key(status, "warehouse_name", "data_as_of")["idle"] == ts(NOW)
    assert [r.warehouse_name for r in status.collect()][0] == "at100"
    assert [r.warehouse_name for r in status.collect()][-1] == "zero"
    counts = quota.quota_status_counts(status).first()
    assert tuple(counts) == (2, 1, 1, 2)


def test_quota_frequencies(frame):
    config = frame(
        CONFIG,
        _config(*[(f, f, 100, None, True) for f in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY", "NEVER")]),
    )
    # 31 March 2024 is a Sunday: its week began on the 25th.
    days = ["2024-03-31", "2024-03-25", "2024-03-24", "2024-03-01", "2024-02-29", "2024-01-01", "2023-12-31"]
    data = [
        (f, ts(d), ts(d), float(10**i))
        for f in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY", "NEVER")
        for i, d in enumerate(days)
    ]
    usage = frame(METERING, data)
    status = quota.quota_status(config, usage, "warehouse_name", "SUSPENDED", NOW, honor_frequency=True)
    assert by_key(status, "warehouse_name", "credits_used") == {
        "DAILY": 1.0,
        "WEEKLY": 11.0,
        "MONTHLY": 1111.0,
        "YEARLY": 111111.0,
    }
    plain = quota.quota_status(config, usage, "warehouse_name", "SUSPENDED", NOW)
    assert set(by_key(plain, "warehouse_name", "credits_used").values()) == {1.0}


def test_gauges(frame):
    df = frame("pct_used double", [(None,), (69.9,), (70.0,), (85.0,), (99.9,), (100.0,)])
    assert [r[0] for r in df.select(quota.gauge_band()).collect()] == [
        "green", "green", "yellow", "orange", "orange", "red",
    ]


def test_alerts_respect_switches_and_the_log(frame):
    config = frame(
        "warehouse_name string, credit_limit double, is_active boolean, alert_threshold_70 boolean, alert_threshold_85 boolean, alert_threshold_95 boolean",
        [("W", 100.0, True, False, True, True), ("Z", 0.0, True, True, True, True), ("X", 1.0, False, True, True, True)],
    )
    usage = frame(
        METERING,
        [(w, ts("2024-03-30 10:00:00"), ts("2024-03-30 11:00:00"), c) for w, c in (("W", 60.0), ("W", 40.0), ("Z", 5.0), ("X", 5.0))],
    )
    alerts = quota.evaluate_quota_alerts(config, usage, "warehouse_name", "WAREHOUSE", "SUSPENDED", "2024-03-30", "2024-03-31")
    assert sorted(by_key(alerts, "threshold_pct", "status").items()) == [
        (85.0, "ACTION_REQUIRED"),
        (95.0, "CRITICAL"),
        (100.0, "SUSPENDED"),
    ]
    assert quota.not_yet_alerted(alerts, alerts).count() == 0
    assert quota.not_yet_alerted(alerts, alerts.where("threshold_pct < 100")).count() == 1


def test_alerts_follow_the_frequency_and_the_range(frame):
    config = frame(CONFIG, _config(*[(f, f, 10, None, True) for f in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY", "NEVER")]))
    names = ("DAILY", "WEEKLY", "MONTHLY", "YEARLY", "NEVER")
    days = (("2024-03-20", 6.0), ("2024-03-30", 6.0), ("2024-04-01", 100.0))
    usage = frame(METERING, [(n, ts(d), ts(d), c) for n in names for d, c in days])
    alerts = quota.evaluate_quota_alerts(config, usage, "warehouse_name", "WAREHOUSE", "SUSPENDED", "2024-03-30", "2024-03-31 12:00:00")
    full = alerts.where("threshold_pct = 100")
    # Twelve credits in the month and in the year; six in the week and on the day; April is not known yet.
    assert by_key(full, "resource_name", "window_start") == {"MONTHLY": ts("2024-03-01"), "YEARLY": ts("2024-01-01")}


def test_nothing_after_the_reference_time_counts(frame):
    config = frame(CONFIG, _config(("W", "DAILY", 10, None, True)))
    usage = frame(METERING, [("W", ts(d), ts(d), c) for d, c in (("2024-01-10 01:00:00", 1.0), ("2024-01-12 01:00:00", 50.0))])
    status = quota.quota_status(config, usage, "warehouse_name", "SUSPENDED", "2024-01-10 23:59:59").first()
    assert (status.credits_used, status.pct_used, status.status) == (1.0, 10.0, "OK")
    assert filters.lookback(usage, "start_time", 7, "day", "2024-01-11").count() == 1


# ---- sizing -----------------------------------------------------------------------------------------


def test_sizing_rules_see_rounded_values(frame):
    df = frame(
        "warehouse_name string, avg_running double, avg_queued double, max_queued double, periods_with_queue long, total_periods long",
        [
            ("a", 1.0, 0.0, 1.001, 1, 10),
            ("b", 1.0, 0.201, 1.0, 1, 8),
            ("c", 0.0999, 0.0, 0.0, 0, 10),
            ("d", 0.1, 0.0, 0.0, 0, 10),
            ("e", 0.05, 0.2, 1.0, 0, 0),
        ],
    )
    out = sizing.recommend_size(df)
    assert by_key(out, "warehouse_name", "recommendation") == {
        "a": "SCALE_UP", "b": "REVIEW_SIZE", "c": "OVERSIZED", "d": "OK", "e": "OK",
    }
    assert by_key(out, "warehouse_name", "queue_pct") == {"a": 10.0, "b": 13.0, "c": 0.0, "d": 0.0, "e": 0.0}


def test_autosuspend_grades(frame):
    raw = frame(
        "NAME string, SIZE string, AUTO_SUSPEND string, MIN_CLUSTER_COUNT string, MAX_CLUSTER_COUNT string",
        [(v or "none", "S", v, "1", m) for v, m in ((None, None), ("abc", "1"), ("0", "3"), ("60", "x"), ("300", "2"), ("600", "1"), ("601", "1"))],
    )
    out = sizing.autosuspend_eval(sizing.normalize_warehouse_settings(raw))
    assert by_key(out, "warehouse_name", "short_eval") == {
        "none": "DISABLED", "abc": "DISABLED", "0": "LE_5_MIN", "60": "LE_5_MIN", "300": "LE_5_MIN",
        "600": "LE_10_MIN", "601": "TOO_LONG",
    }
    assert by_key(out, "warehouse_name", "detailed_eval") == {
        "none": "DISABLED", "abc": "DISABLED", "0": "AGGRESSIVE", "60": "AGGRESSIVE", "300": "RECOMMENDED",
        "600": "MODERATE", "601": "TOO_LONG",
    }
    assert by_key(out, "warehouse_name", "multi_cluster")["0"] == "1-3"
    assert by_key(out, "warehouse_name", "multi_cluster")["60"] == "—"
    assert [r.warehouse_name for r in out.collect()][:2] == ["abc", "none"]


def test_resource_monitors(frame):
    rm = frame(
        "name string, credit_quota double, used_credits double, remaining_credits double, owner string",
        [("a", 100.0, 89.96, 0.0, "o"), ("b", 100.0, 70.0, 0.0, "o"), ("c", 0.0, 5.0, 0.0, "o"), ("d", None, 5.0, 0.0, "o"), ("e", 100.0, 69.9, 0.0, "o")],
    )
    out = sizing.resource_monitor_status(rm)
    assert by_key(out, "name", "alert") == {"a": "CRITICAL", "b": "WATCH", "c": "OK", "d": "OK", "e": "OK"}
    assert [r.name for r in out.collect()] == ["a", "b", "e", "c", "d"]


# ---- performance ---------------------------------------------------------------------------------------


def test_heatmap_sunday_and_hours(frame):
    qh = frame("start_time timestamp_ntz", [(ts("2024-03-31 00:00:00"),), (ts("2024-03-30 23:59:59"),)])
    assert rows(performance.activity_heatmap(qh, NOW)) == [(0, 0, 1, "Dim"), (6, 23, 1, "Sam")]


def test_perf_summary_with_null_durations_and_nothing(frame):
    qh = frame("start_time timestamp_ntz, total_elapsed_time long", [(ts("2024-01-01"), v) for v in (None, 1000, 2000, 60000, 60001)])
    row = performance.perf_summary(qh, "2024-01-01", "2024-01-02").first()
    assert tuple(row) == (5, 30.75, 31.0, 60.0, 1)
    empty = performance.perf_summary(qh, "2025-01-01", "2025-01-02").first()
    assert tuple(empty) == (0, None, None, None, 0)


def test_running_seconds_are_whole(frame):
    qh = frame(
        "user_name string, warehouse_name string, start_time timestamp_ntz, execution_status string, query_text string",
        [("u", "w", ts("2024-03-31 11:59:58.5"), "RUNNING", "x" * 300), ("u", "w", ts("2024-03-31 10:59:59"), "QUEUED", "y")],
    )
    assert [(r.running_sec, len(r.query_preview)) for r in performance.running_queries(qh, NOW).collect()] == [(1, 120)]


# ---- users ------------------------------------------------------------------------------------------------

QUERIES = "warehouse_name string, user_name string, start_time timestamp_ntz, total_elapsed_time long"


def test_null_user_ranks_but_shows_as_other_and_ties_break_by_name(frame):
    at = ts("2024-03-30")
    data = [("W", None, at, 10**9)] + [("W", f"u{i}", at, 60_000) for i in range(9)]
    data += [("Z", "u0", at, 0), (None, "u1", at, 60_000)]
    out = users.user_share_by_warehouse(frame(QUERIES, data), NOW, k=8)
    shares = by_key(out, "user_name", "total_min")
    # The NULL user takes one of the eight places; u7 and u8 lose the tie.
    assert set(shares) == {"Other", *[f"u{i}" for i in range(7)]}
    assert set(r.warehouse_name for r in out.collect()) == {"W"}
    assert sum(r.share_pct for r in out.collect()) == pytest.approx(100)


def test_matrix_needs_more_than_the_minimum(frame):
    at = ts("2024-03-30")
    data = [("A", "u", at, 20 * 60_000), ("B", "u", at, 20 * 60_000 + 1), ("B", "other", at, 10**9)]
    qh = frame(QUERIES, data)
    wanted = qh.select("user_name").where("user_name = 'u'").distinct()
    matrix = users.user_warehouse_matrix(qh, NOW, wanted)
    assert [r.warehouse_name for r in matrix.collect()] == ["B"]
    wide = users.user_warehouse_pivot(matrix, ["u", "absent"]).first()
    assert wide.absent == 0.0


def test_config_changes_are_null_safe(frame):
    schema = "warehouse_name string, credit_limit decimal(18,4), note string"
    stored = frame(schema, [("a", Decimal(1), None), ("b", Decimal(2), "x"), ("b", Decimal(2), "x")])
    edited = frame(schema, [("a", Decimal(1), None), ("b", Decimal("2.5"), "x"), ("c", Decimal(-1), None)])
    changes = users.config_changes(edited, stored)
    assert sorted(r.warehouse_name for r in changes.collect()) == ["b", "c"]
    assert [(r.warehouse_name, r.credit_limit) for r in users.accepted_changes(changes).collect()] == [("b", Decimal(2))]


# ---- security -----------------------------------------------------------------------------------------------

USERS = "name string, email string, default_role string, has_password string, has_rsa_public_key string, ext_authn_duo string, has_mfa boolean, disabled string, last_success_login timestamp_ntz, deleted_on timestamp_ntz"


def _user(name, mfa="false", disabled="false", login=None, deleted=None, has_mfa=None):
    return (name, f"{name}@x", "R", "true", "false", mfa, has_mfa, disabled, login, deleted)


def test_inactivity_boundaries(frame):
    exactly_90 = ts("2024-01-01 12:00:00")  # 90 days before NOW
    us = frame(
        USERS,
        [
            _user("edge", login=exactly_90),
            _user("late", login=ts("2024-01-01 11:59:59")),
            _user("never"),
            _user("off", disabled="true"),
            _user("gone", deleted=ts("2024-01-01")),
            _user("unknown", disabled=None),
            _user("fresh", login=ts("2024-03-31")),
        ],
    )
    assert [r.name for r in security.stale_users(us, NOW).collect()] == ["never", "late"]
    posture = security.user_posture(us, NOW).first()
    assert (posture.total_users, posture.disabled_users, posture.inactive_30d) == (6, 1, 5)


def test_privileged_without_mfa_counts_users_once(frame):
    us = frame(USERS, [_user("a"), _user("b", mfa="true"), _user("c", disabled="true"), _user("d", mfa=None)])
    gu = frame(
        "grantee_name string, role string, deleted_on timestamp_ntz",
        [("a", "ACCOUNTADMIN", None), ("a", "ACCOUNTADMIN", None), ("a", "SYSADMIN", None), ("a", "SECURITYADMIN", ts(NOW)), ("b", "SYSADMIN", None), ("c", "SYSADMIN", None), ("d", "SYSADMIN", None)],
    )
    found = security.privileged_without_mfa(us, gu)
    assert [(r.user_name, r.privileged_role) for r in found.collect()] == [("a", "ACCOUNTADMIN"), ("a", "SYSADMIN")]
    assert security.privileged_without_mfa_count(us, gu).first().cnt == 1


@pytest.mark.parametrize(
    ("with_mfa", "without", "status"),
    [(9, 1, "OK"), (8, 2, "WARN"), (6, 4, "WARN"), (5, 5, "CRITICAL"), (0, 0, None)],
)
def test_scorecard_mfa_bands(frame, with_mfa, without, status):
    people = [_user(f"m{i}", mfa="true", login=ts(NOW)) for i in range(with_mfa)]
    people += [_user(f"n{i}", login=ts(NOW)) for i in range(without)]
    card = governance.compliance_scorecard(
        frame(USERS, people),
        frame("grantee_name string, role string, deleted_on timestamp_ntz", [(f"g{i}", "ACCOUNTADMIN", None) for i in range(3)]),
        frame("name string", []),
        frame("name string, auto_suspend double", [("w", 600.0), ("v", 60.0)]),
        frame("name string", []),
        frame("policy_name string, deleted string", []),
        frame("policy_name string, deleted string", [("p", None)]),
        frame("warehouse_name string, start_time timestamp_ntz, bytes_spilled_to_remote_storage long", []),
        NOW,
    )
    statuses = by_key(card, "control", "status")
    assert statuses.get("mfa_enabled") == status
    assert statuses["network_policy"] == "CRITICAL"
    assert statuses["top_admin_count"] == "OK"
    assert statuses["resource_monitors"] == "WARN"
    assert statuses["auto_suspend"] == "OK"
    assert statuses["masking_policies"] == "INFO"
    assert statuses["remote_spill"] == "OK"
    score = governance.compliance_score(card).first()
    assert score.ok + score.warn + score.critical == score.total == (10 if status else 9)


def test_health_context_leaves_missing_figures_out(frame):
    ctx = governance.health_context(
        frame("event_timestamp timestamp_ntz, is_success string", []),
        frame("start_time timestamp_ntz, credits_used double", []),
        frame(USERS, [_user("a", has_mfa=False), _user("b", has_mfa=None)]),
        NOW,
    ).first()
    assert ctx.ctx == '{"failed_logins_24h":0,"total_users":2,"users_without_mfa":1}'


# ---- names ----------------------------------------------------------------------------------------------------


def test_generated_names(frame):
    rules = frame(
        "layer_code string, prefix string, suffix string, separator string, description string, enabled boolean",
        [("DSI", "DSI", None, "_", "", True), ("SCHEMA", None, "S", "-", "", True), ("EMPTY", "", "", None, "", True), ("OFF", "X", None, "_", "", False)],
    )
    requests = frame("layer_code string, project_id string, name string", [(layer, "p1", "t") for layer in ("DSI", "SCHEMA", "EMPTY", "OFF", "NEW")])
    named = by_key(control.name_objects(rules, requests, name="name"), "layer_code", "generated_name")
    assert named == {"DSI": "DSI_P1_T", "SCHEMA": "SCHEMA-P1-T-S", "EMPTY": "EMPTY_P1_T", "OFF": "OFF_P1_T", "NEW": "NEW_P1_T"}
    plain = by_key(control.name_objects(rules, requests, fallback_to_layer=False), "layer_code", "generated_name")
    assert plain == {"DSI": "DSI_P1", "SCHEMA": "P1-S", "EMPTY": "P1", "OFF": "OFF_P1", "NEW": "NEW_P1"}
    preview = by_key(control.preview_names(rules, "retail"), "layer_code", "generated_name")
    assert preview == {"DSI": "DSI_RETAIL", "SCHEMA": "RETAIL-S", "EMPTY": "RETAIL"}


def test_connection_symbols(frame):
    df = frame("connection_name string, status string", [("a", "CONNECTED"), ("b", "ERROR"), ("c", "PENDING"), ("d", "?"), ("e", None)])
    assert [r.symbol for r in control.connection_status(df).collect()] == ["✅", "❌", "🔄", "❓", "❓"]


def test_policy_counts(frame):
    live = frame("name string, deleted string", [("a", None), ("b", "x")])
    out = by_key(security.policy_counts(network=live, masking=live), "policy_kind", "policies")
    assert out == {"network": 2, "masking": 1}


def test_failed_login_totals_agree(spark):
    from checks.registry import Logs
    from tests.conftest import SF_DIR

    lh = Logs(spark, SF_DIR)("login_history")
    period = ("2024-01-01", "2024-01-31")
    listed = security.failed_logins(lh, *period).agg(F.sum("failed_attempts")).first()[0]
    assert listed == security.failed_logins_total(lh, *period).first().total_failed
