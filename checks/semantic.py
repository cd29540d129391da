from gaugework.plans import questions as q
from gaugework.plans.views import COST_PERFORMANCE, MAINTENANCE, SECURITY_MONITORING

from checks.registry import E_TS, EVENTS, LINES, R, query, rounded

# Metrics that are floats; the others are counts or sums of integers.
DIGITS = 6


def _floats(df, names):
    floats = {c for c, kind in df.dtypes if kind == "double"}
    return rounded(df, DIGITS, *[n for n in names if n in floats])


def _f(expr: str) -> str:
    return R(expr, DIGITS)


def _i(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def _n(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


YES, NO, MFA = "is_success = 'YES'", "is_success = 'NO'", "second_authentication_factor IS NOT NULL"
STRONG = """password_min_length >= 12 AND password_min_upper_case_chars >= 1 AND password_min_lower_case_chars >= 1
            AND password_min_numeric_chars >= 1 AND password_min_special_chars >= 1"""

# Logical table -> usage log and metric -> SQL, written out from the definitions.
SECURITY = {
    "login_history": {
        "total_login_attempts": "count(*)",
        "failed_login_attempts": _n(NO),
        "successful_login_attempts": _n(YES),
        "unique_login_users": "count(DISTINCT user_name)",
        "unique_login_ips": "count(DISTINCT client_ip)",
        "mfa_login_usage": _n(MFA),
        "users_with_login_failures": f"count(DISTINCT CASE WHEN {NO} THEN user_name END)",
        "ips_with_login_failures": f"count(DISTINCT CASE WHEN {NO} THEN client_ip END)",
        "login_success_rate_pct": _f(f"CAST({_n(YES)} AS DOUBLE) * 100 / nullif(count(*), 0)"),
        "mfa_adoption_pct": _f(f"CAST({_n(MFA)} AS DOUBLE) * 100 / nullif({_n(YES)}, 0)"),
    },
    "sessions": {
        "total_sessions": "count(*)",
        "active_sessions": _n("closed_reason IS NULL"),
        "closed_sessions": _n("closed_reason IS NOT NULL"),
        "unique_session_users": "count(DISTINCT user_name)",
        "unique_session_apps": "count(DISTINCT client_application_id)",
    },
    "users": {
        "total_users": "count(*)",
        "active_users": _n("disabled IS NULL OR disabled = false"),
        "mfa_enabled_users": _n("has_mfa = true"),
        "mfa_disabled_users": _n("has_mfa = false OR has_mfa IS NULL"),
        "user_mfa_adoption_rate": _f(f"CAST({_n('has_mfa = true')} AS DOUBLE) * 100 / nullif(count(*), 0)"),
    },
    "password_policies": {
        "total_password_policies": "count(*)",
        "active_password_policies": _n("deleted IS NULL"),
        "avg_min_password_length": _f("avg(password_min_length)"),
        "strong_password_policies": _n(STRONG),
    },
    "session_policies": {
        "total_session_policies": "count(*)",
        "active_session_policies": _n("deleted IS NULL"),
        "avg_idle_timeout_mins": _f("avg(session_idle_timeout_mins)"),
    },
    "network_policies": {
        "total_network_policies": "count(*)",
        "active_network_policies": _n("deleted IS NULL"),
        "policies_with_allowed_ips": _n("allowed_ip_list IS NOT NULL"),
        "policies_with_blocked_ips": _n("blocked_ip_list IS NOT NULL"),
    },
}

QUERY_METRICS = {
    "total_queries": "count(query_id)",
    "failed_queries": _n("execution_status = 'FAIL'"),
    "successful_queries": _n("execution_status = 'SUCCESS'"),
    "avg_query_ms": _f("avg(execution_time)"),
    "avg_elapsed_ms": _f("avg(total_elapsed_time)"),
    "bytes_scanned": _i("sum(bytes_scanned)"),
    "bytes_spilled_to_local": _i("sum(bytes_spilled_to_local_storage)"),
    "bytes_spilled_to_remote": _i("sum(bytes_spilled_to_remote_storage)"),
    "cache_hit_rate": _f("avg(percentage_scanned_from_cache)"),
    "credits_cloud_services": _f("sum(credits_used_cloud_services)"),
}
LOGIN_METRICS = {
    "total_logins": "count(event_id)",
    "failed_logins": _n(NO),
    "unique_login_ips": "count(DISTINCT client_ip)",
    "mfa_login_usage": _n(MFA),
    "login_success_rate_pct": _f(f"CAST({_n(YES)} AS DOUBLE) * 100 / nullif(count(event_id), 0)"),
    "mfa_adoption_pct": _f(f"CAST({_n(MFA)} AS DOUBLE) * 100 / nullif({_n(YES)}, 0)"),
}
WAREHOUSE_METRICS = {
    "total_credits_used": _f("sum(credits_used)"),
    "total_credits_compute": _f("sum(credits_used_compute)"),
    "avg_credits_per_hour": _f("avg(credits_used)"),
}
TASK_METRICS = {
    "total_task_runs": "count(run_id)",
    "successful_tasks": _n("state = 'SUCCEEDED'"),
    "failed_tasks": _n("state = 'FAILED'"),
    "task_success_rate": _f(f"""CAST({_n("state = 'SUCCEEDED'")} AS DOUBLE) * 100 / nullif(count(run_id), 0)"""),
}
STORAGE_METRICS = {
    # Whole numbers, exact as floats.
    "total_storage_bytes": "sum(storage_bytes)",
    "total_stage_bytes": "sum(stage_bytes)",
    "total_failsafe_bytes": "sum(failsafe_bytes)",
}
MAINTENANCE_SQL = {
    "query_history": QUERY_METRICS,
    "query_attribution_history": {
        "credits_compute": _f("sum(credits_attributed_compute)"),
        "credits_acceleration": _f("sum(credits_used_query_acceleration)"),
    },
    "login_history": LOGIN_METRICS,
    "sessions": {"total_sessions": "count(session_id)", "active_sessions": _n("closed_reason IS NULL")},
    "warehouse_metering_history": WAREHOUSE_METRICS,
    "storage_usage": STORAGE_METRICS,
    "database_storage_usage_history": {"avg_database_bytes": _f("avg(average_database_bytes)")},
    "stage_storage_usage_history": {"total_stage_storage": "sum(average_stage_bytes)"},
    "users": {
        "total_users": "count(name)",
        "active_users": _n("disabled IS NULL OR disabled = false"),
        "mfa_enabled_users": _n("has_mfa = true"),
        "users_without_mfa": _n("has_mfa = false"),
        "mfa_adoption_rate": _f(f"CAST({_n('has_mfa = true')} AS DOUBLE) * 100 / nullif(count(name), 0)"),
    },
    "roles": {"total_roles": "count(name)"},
    "grants_to_users": {"total_role_grants_to_users": "count(role)"},
    "grants_to_roles": {"total_privilege_grants": "count(privilege)"},
    "password_policies": {"strong_password_policies": _n(STRONG)},
    "network_policies": {"active_network_policies": _n("deleted IS NULL")},
    "task_history": TASK_METRICS,
    "serverless_task_history": {"total_serverless_credits": "sum(credits_used)"},
    "pipe_usage_history": {
        "total_pipe_credits": "sum(credits_used)",
        "total_files_inserted": _i("sum(files_inserted)"),
        "total_bytes_inserted": _i("sum(bytes_inserted)"),
    },
    "automatic_clustering_history": {
        "total_clustering_credits": "sum(credits_used)",
        "total_bytes_reclustered": _i("sum(num_bytes_reclustered)"),
    },
    "materialized_view_refresh_history": {
        "total_mv_credits": "sum(credits_used)",
        "total_mv_refreshes": "count(credits_used)",
    },
    "replication_usage_history": {
        "total_replication_credits": "sum(credits_used)",
        "total_bytes_replicated": _i("sum(bytes_transferred)"),
    },
    "data_transfer_history": {"total_transfer_bytes": _i("sum(bytes_transferred)")},
    "warehouse_load_history": {
        "avg_running_queries": _f("avg(avg_running)"),
        "avg_queued_load": _f("avg(avg_queued_load)"),
    },
    "metering_daily_history": {
        "total_daily_credits": _f("sum(credits_used)"),
        "total_compute_credits_daily": _f("sum(credits_used_compute)"),
    },
}


def _select(metrics: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in metrics.items())


def _side_by_side(groups: dict[str, dict[str, str]]) -> str:
    parts = [f"(SELECT {_select(m)} FROM {log}) g{i}" for i, (log, m) in enumerate(groups.items())]
    return "SELECT * FROM " + " CROSS JOIN ".join(parts)


def _all(t, view):
    return _floats(view.query(t, view.metric_names()), view.metric_names())


@query("security_metrics", " ".join(SECURITY), _side_by_side(SECURITY))
def _(t):
    return _all(t, SECURITY_MONITORING)


@query("maintenance_metrics", " ".join(MAINTENANCE_SQL), _side_by_side(MAINTENANCE_SQL))
def _(t):
    return _all(t, MAINTENANCE)


QH_FACTS = [f for f, table in COST_PERFORMANCE.facts.items() if table == "query_history"]
QA_FACTS = [f for f, table in COST_PERFORMANCE.facts.items() if table == "query_attribution"]
_FLOAT_FACTS = {"percentage_scanned_from_cache", "credits_used_cloud_services", *QA_FACTS}


def _fact_sql(facts):
    out = []
    for f in facts:
        total = _f(f"sum({f})") if f in _FLOAT_FACTS else _i(f"sum({f})")
        out += [f"{total} AS sum_{f}", f"{_f(f'avg({f})')} AS avg_{f}"]
    return ", ".join(out)


@query(
    "cost_performance_facts",
    "query_history query_attribution_history",
    f"""SELECT * FROM (SELECT warehouse_name, {_fact_sql(QH_FACTS)} FROM query_history GROUP BY 1)
        FULL JOIN (SELECT warehouse_name, {_fact_sql(QA_FACTS)} FROM query_attribution_history GROUP BY 1) USING (warehouse_name)""",
)
def _(t):
    asked = [f"{kind}({f})" for f in QH_FACTS + QA_FACTS for kind in ("sum", "avg")]
    out = COST_PERFORMANCE.query(t, asked, ["warehouse_name"])
    return _floats(out, out.columns)


@query(
    "query_metrics_by_warehouse_status",
    "query_history",
    f"SELECT warehouse_name, execution_status, {_select(QUERY_METRICS)} FROM query_history GROUP BY 1, 2",
)
def _(t):
    out = MAINTENANCE.query(
        t, list(QUERY_METRICS), ["warehouse_name", "execution_status"]
    )
    return _floats(out, out.columns)


@query(
    "login_metrics_by_client",
    "login_history",
    f"SELECT reported_client_type, {_select(SECURITY['login_history'])} FROM login_history GROUP BY 1",
)
def _(t):
    out = SECURITY_MONITORING.query(
        t, list(SECURITY["login_history"]), ["reported_client_type"]
    )
    return _floats(out, out.columns)


_DAY = "CAST(date_trunc('day', {}) AS TIMESTAMP) AS period"


@query(
    "daily_account_trend",
    "query_history login_history warehouse_metering_history",
    f"""SELECT * FROM (SELECT {_DAY.format('start_time')}, {_select(QUERY_METRICS)} FROM query_history
                       WHERE execution_status <> 'RUNNING' GROUP BY 1)
        FULL JOIN (SELECT {_DAY.format('event_timestamp')}, {_select(LOGIN_METRICS)} FROM login_history GROUP BY 1) USING (period)
        FULL JOIN (SELECT {_DAY.format('start_time')}, {_select(WAREHOUSE_METRICS)} FROM warehouse_metering_history GROUP BY 1)
            USING (period)""",
)
def _(t):
    names = [*QUERY_METRICS, *LOGIN_METRICS, *WAREHOUSE_METRICS]
    out = MAINTENANCE.query(
        t, names, grain="day", filters={"qh": "execution_status <> 'RUNNING'"}
    )
    return _floats(out, names)


@query(
    "monthly_tasks_and_storage",
    "task_history storage_usage",
    f"""SELECT * FROM (SELECT CAST(date_trunc('month', scheduled_time) AS TIMESTAMP) AS period, {_select(TASK_METRICS)}
                       FROM task_history GROUP BY 1)
        FULL JOIN (SELECT CAST(date_trunc('month', usage_date) AS TIMESTAMP) AS period, {_select(STORAGE_METRICS)}
                   FROM storage_usage GROUP BY 1) USING (period)""",
)
def _(t):
    names = [*TASK_METRICS, *STORAGE_METRICS]
    return _floats(MAINTENANCE.query(t, names, grain="month"), names)


@query(
    "monthly_storage_last_snapshot",
    "storage_usage",
    f"""SELECT CAST(date_trunc('month', usage_date) AS TIMESTAMP) AS period, max_by(storage_bytes, usage_date) AS total_storage_bytes
        FROM storage_usage GROUP BY 1""",
)
def _(t):
    out = MAINTENANCE.query(
        t, ["total_storage_bytes"], grain="month", semi_additive="last"
    )
    return _floats(out, ["total_storage_bytes"])


@query(
    "metrics_by_user_role",
    "query_history login_history users",
    f"""SELECT * FROM (SELECT u.default_role AS users_default_role, {_select(QUERY_METRICS)} FROM query_history h
                       LEFT JOIN users u ON h.user_name = u.name GROUP BY 1)
        FULL JOIN (SELECT u.default_role AS users_default_role, {_select(LOGIN_METRICS)} FROM login_history l
                   LEFT JOIN users u ON l.user_name = u.name GROUP BY 1) USING (users_default_role)""",
)
def _(t):
    names = [*QUERY_METRICS, *LOGIN_METRICS]
    return _floats(MAINTENANCE.query(t, names, ["users.default_role"]), names)


# ---- named questions -----------------------------------------------------------------

QH, LH, WM = "query_history", "login_history", "warehouse_metering_history"


@query(
    "failed_logins_and_expensive_queries",
    f"{LH} {QH}",
    f"""SELECT user_name, failed_logins, total_sec, cloud_credits
        FROM (SELECT user_name, count(*) AS failed_logins FROM {LH}
              WHERE is_success = 'NO' AND event_timestamp >= {E_TS} - INTERVAL 30 DAY GROUP BY 1)
        JOIN (SELECT user_name, {R('sum(total_elapsed_time) * 0.001', 2)} AS total_sec,
                     {R('sum(credits_used_cloud_services)', 4)} AS cloud_credits
              FROM {QH} WHERE start_time >= {E_TS} - INTERVAL 30 DAY GROUP BY 1) USING (user_name)
        ORDER BY cloud_credits DESC NULLS LAST, user_name LIMIT 50""",
)
def _(t):
    return q.failed_logins_and_expensive_queries(t(LH), t(QH), EVENTS)


@query(
    "expensive_failing_warehouses",
    f"{WM} {QH}",
    f"""SELECT warehouse_name, total_credits, coalesce(f, 0) AS failed_queries, coalesce(n, 0) AS total_queries
        FROM (SELECT warehouse_name, {R('sum(credits_used)', 2)} AS total_credits FROM {WM}
              WHERE start_time >= {E_TS} - INTERVAL 30 DAY GROUP BY 1)
        LEFT JOIN (SELECT warehouse_name, {_n("execution_status = 'FAIL'")} AS f, count(*) AS n FROM {QH}
              WHERE start_time >= {E_TS} - INTERVAL 30 DAY GROUP BY 1) USING (warehouse_name)""",
)
def _(t):
    return q.expensive_failing_warehouses(t(WM), t(QH), EVENTS)


THIS_MONTH = "FROM line_metering_history WHERE start_time >= TIMESTAMP '2001-11-01'"


@query(
    "total_cost_all_services",
    "line_metering_history",
    f"""SELECT {R('coalesce(sum(credits_used), 0)', 2)} AS credits, {R('coalesce(sum(credits_used), 0) * 4', 2)} AS cost_usd
        {THIS_MONTH}""",
)
def _(t):
    return q.total_cost(t("line_metering_history"), LINES)


@query(
    "total_cost_by_service",
    "line_metering_history",
    f"""SELECT service_type, {R('sum(credits_used)', 2)} AS credits, {R('sum(credits_used) * 4', 2)} AS cost_usd
        {THIS_MONTH} GROUP BY 1""",
)
def _(t):
    return q.total_cost_by_service(t("line_metering_history"), LINES)


def _ops(operation: str, log: str, amount: str) -> str:
    return f"""SELECT '{operation}' AS operation, CAST(date_trunc('month', start_time) AS TIMESTAMP) AS month,
                      {R('sum(credits_used)', 2)} AS credits, {_i(amount)} AS bytes
               FROM {log} WHERE start_time >= TIMESTAMP '2001-01-01' GROUP BY 2"""


OPS_LOGS = "pipe_usage_history automatic_clustering_history serverless_task_history"


@query(
    "ops_cost_summary",
    OPS_LOGS,
    " UNION ALL ".join(
        [
            _ops("pipe", "pipe_usage_history", "sum(bytes_inserted)"),
            _ops("clustering", "automatic_clustering_history", "sum(num_bytes_reclustered)"),
            _ops("serverless_task", "serverless_task_history", "NULL"),
        ]
    ),
)
def _(t):
    return q.ops_cost_summary({log: t(log) for log in OPS_LOGS.split()}, LINES, months=10)


@query(
    "daily_credit_trend",
    "metering_daily_history",
    f"""SELECT usage_date, {R('sum(credits_used)', 3)} AS credits FROM metering_daily_history
        WHERE usage_date >= DATE '2023-12-31' GROUP BY 1""",
)
def _(t):
    return q.daily_credit_trend(t("metering_daily_history"), EVENTS)
