"""The three metric views: cost and performance, security, maintenance.

Known peculiarities kept on purpose: ``mfa_adoption_pct`` of logins divides all logins
with a second factor, failed ones too, by the successful ones and can exceed 100; the
storage totals add daily snapshots up over days (``semi_additive='last'`` does not); the
three notions of MFA (enrolled authenticator, ``has_mfa``, second factor at login) stay
separate metrics.
"""

from __future__ import annotations

from gaugework.plans.semantic import Metric, Relationship, SemanticView

_QUERY_FACTS = (
    "total_elapsed_time execution_time compilation_time queued_provisioning_time queued_overload_time "
    "bytes_scanned bytes_written bytes_spilled_to_local_storage bytes_spilled_to_remote_storage "
    "rows_produced rows_inserted rows_updated rows_deleted partitions_scanned partitions_total "
    "percentage_scanned_from_cache credits_used_cloud_services"
).split()
_ATTRIBUTION_FACTS = "credits_attributed_compute credits_used_query_acceleration".split()

_QUERY_DIMENSIONS = (
    "query_id query_text query_type user_name role_name warehouse_name warehouse_size database_name "
    "schema_name execution_status error_code error_message start_time end_time query_tag"
).split()

COST_PERFORMANCE = SemanticView(
    name="cost_performance",
    sources={"query_history": "query_history", "query_attribution": "query_attribution_history"},
    dimensions={d: "query_history" for d in _QUERY_DIMENSIONS},
    facts={
        **{f: "query_history" for f in _QUERY_FACTS},
        **{f: "query_attribution" for f in _ATTRIBUTION_FACTS},
    },
)

_STRONG_PASSWORD = (
    "password_min_length >= 12 AND password_min_upper_case_chars >= 1 AND password_min_lower_case_chars >= 1 "
    "AND password_min_numeric_chars >= 1 AND password_min_special_chars >= 1"
)
_FAILED, _SUCCEEDED = "is_success = 'NO'", "is_success = 'YES'"
_ENABLED = "disabled IS NULL OR disabled = FALSE"


def _count(name: str, table: str, where: str | None = None, expr: str | None = None) -> Metric:
    return Metric(name, table, "count", expr, where)


def _sum(name: str, table: str, expr: str) -> Metric:
    return Metric(name, table, "sum", expr)


def _avg(name: str, table: str, expr: str) -> Metric:
    return Metric(name, table, "avg", expr)


def _distinct(name: str, table: str, expr: str, where: str | None = None) -> Metric:
    return Metric(name, table, "distinct", expr, where)


def _pct(name: str, table: str, num: str, den: str) -> Metric:
    return Metric(name, table, "pct", num=num, den=den)


SECURITY_MONITORING = SemanticView(
    name="security_monitoring",
    sources={
        "login": "login_history",
        "sessions": "sessions",
        "users": "users",
        "pwd_policies": "password_policies",
        "sess_policies": "session_policies",
        "net_policies": "network_policies",
    },
    dimensions={
        **dict.fromkeys(
            (
                "event_timestamp user_name client_ip reported_client_type reported_client_version "
                "first_authentication_factor second_authentication_factor is_success error_code error_message "
                "connection"
            ).split(),
            "login",
        ),
        **dict.fromkeys(
            "session_id created_on authentication_method client_application_id closed_reason".split(), "sessions"
        ),
    },
    metrics=(
        _count("total_login_attempts", "login"),
        _count("failed_login_attempts", "login", _FAILED),
        _count("successful_login_attempts", "login", _SUCCEEDED),
        _distinct("unique_login_users", "login", "user_name"),
        _distinct("unique_login_ips", "login", "client_ip"),
        _count("mfa_login_usage", "login", "second_authentication_factor IS NOT NULL"),
        _distinct("users_with_login_failures", "login", "user_name", _FAILED),
        _distinct("ips_with_login_failures", "login", "client_ip", _FAILED),
        _pct("login_success_rate_pct", "login", "successful_login_attempts", "total_login_attempts"),
        _pct("mfa_adoption_pct", "login", "mfa_login_usage", "successful_login_attempts"),
        _count("total_sessions", "sessions"),
        _count("active_sessions", "sessions", "closed_reason IS NULL"),
        _count("closed_sessions", "sessions", "closed_reason IS NOT NULL"),
        _distinct("unique_session_users", "sessions", "user_name"),
        _distinct("unique_session_apps", "sessions", "client_application_id"),
        _count("total_users", "users"),
        _count("active_users", "users", _ENABLED),
        _count("mfa_enabled_users", "users", "has_mfa"),
        _count("mfa_disabled_users", "users", "has_mfa = FALSE OR has_mfa IS NULL"),
        _pct("user_mfa_adoption_rate", "users", "mfa_enabled_users", "total_users"),
        _count("total_password_policies", "pwd_policies"),
        _count("active_password_policies", "pwd_policies", "deleted IS NULL"),
        _avg("avg_min_password_length", "pwd_policies", "password_min_length"),
        _count("strong_password_policies", "pwd_policies", _STRONG_PASSWORD),
        _count("total_session_policies", "sess_policies"),
        _count("active_session_policies", "sess_policies", "deleted IS NULL"),
        _avg("avg_idle_timeout_mins", "sess_policies", "session_idle_timeout_mins"),
        _count("total_network_policies", "net_policies"),
        _count("active_network_policies", "net_policies", "deleted IS NULL"),
        _count("policies_with_allowed_ips", "net_policies", "allowed_ip_list IS NOT NULL"),
        _count("policies_with_blocked_ips", "net_policies", "blocked_ip_list IS NOT NULL"),
    ),
    time_dimensions={"login": "event_timestamp"},
)

MAINTENANCE = SemanticView(
    name="maintenance",
    sources={
        "qh": "query_history",
        "qa": "query_attribution_history",
        "login": "login_history",
        "sessions": "sessions",
        "wh": "warehouse_metering_history",
        "storage": "storage_usage",
        "db_storage": "database_storage_usage_history",
        "stage_storage": "stage_storage_usage_history",
        "users": "users",
        "roles": "roles",
        "grants_users": "grants_to_users",
        "grants_roles": "grants_to_roles",
        "pwd_policies": "password_policies",
        "sess_policies": "session_policies",
        "net_policies": "network_policies",
        "task_hist": "task_history",
        "serverless_task": "serverless_task_history",
        "pipe_usage": "pipe_usage_history",
        "clustering": "automatic_clustering_history",
        "mv_refresh": "materialized_view_refresh_history",
        "replication": "replication_usage_history",
        "data_transfer": "data_transfer_history",
        "wh_load": "warehouse_load_history",
        "metering_daily": "metering_daily_history",
    },
    dimensions={
        **dict.fromkeys(
            (
                "query_id query_text database_name schema_name query_type user_name role_name warehouse_name "
                "warehouse_size warehouse_type query_tag execution_status error_code error_message"
            ).split(),
            "qh",
        ),
        **dict.fromkeys(
            (
                "client_ip reported_client_type is_success first_authentication_factor "
                "second_authentication_factor"
            ).split(),
            "login",
        ),
        **dict.fromkeys("session_id authentication_method closed_reason".split(), "sessions"),
        "usage_date": "storage",
    },
    time_dimensions={
        "qh": "start_time",
        "login": "event_timestamp",
        "wh": "start_time",
        "storage": "usage_date",
        "task_hist": "scheduled_time",
    },
    relationships=(
        Relationship("qh", "user_name", "users", "name"),
        Relationship("login", "user_name", "users", "name"),
    ),
    operands=(_count("login_successes", "login", _SUCCEEDED),),
    snapshots={"storage": "usage_date", "db_storage": "usage_date", "stage_storage": "usage_date"},
    metrics=(
        _count("total_queries", "qh", expr="query_id"),
        _count("failed_queries", "qh", "execution_status = 'FAIL'"),
        _count("successful_queries", "qh", "execution_status = 'SUCCESS'"),
        _avg("avg_query_ms", "qh", "execution_time"),
        _avg("avg_elapsed_ms", "qh", "total_elapsed_time"),
        _sum("bytes_scanned", "qh", "bytes_scanned"),
        _sum("bytes_spilled_to_local", "qh", "bytes_spilled_to_local_storage"),
        _sum("bytes_spilled_to_remote", "qh", "bytes_spilled_to_remote_storage"),
        _avg("cache_hit_rate", "qh", "percentage_scanned_from_cache"),
        _sum("credits_cloud_services", "qh", "credits_used_cloud_services"),
        _sum("credits_compute", "qa", "credits_attributed_compute"),
        _sum("credits_acceleration", "qa", "credits_used_query_acceleration"),
        _count("total_logins", "login", expr="event_id"),
        _count("failed_logins", "login", _FAILED),
        _distinct("unique_login_ips", "login", "client_ip"),
        _count("mfa_login_usage", "login", "second_authentication_factor IS NOT NULL"),
        _pct("login_success_rate_pct", "login", "login_successes", "total_logins"),
        _pct("mfa_adoption_pct", "login", "mfa_login_usage", "login_successes"),
        _count("total_sessions", "sessions", expr="session_id"),
        _count("active_sessions", "sessions", "closed_reason IS NULL"),
        _sum("total_credits_used", "wh", "credits_used"),
        _sum("total_credits_compute", "wh", "credits_used_compute"),
        _avg("avg_credits_per_hour", "wh", "credits_used"),
        _sum("total_storage_bytes", "storage", "storage_bytes"),
        _sum("total_stage_bytes", "storage", "stage_bytes"),
        _sum("total_failsafe_bytes", "storage", "failsafe_bytes"),
        _avg("avg_database_bytes", "db_storage", "average_database_bytes"),
        _sum("total_stage_storage", "stage_storage", "average_stage_bytes"),
        _count("total_users", "users", expr="name"),
        _count("active_users", "users", _ENABLED),
        _count("mfa_enabled_users", "users", "has_mfa"),
        # Unlike the security view, users with an unknown state are not counted here.
        _count("users_without_mfa", "users", "has_mfa = FALSE"),
        _pct("mfa_adoption_rate", "users", "mfa_enabled_users", "total_users"),
        _count("total_roles", "roles", expr="name"),
        _count("total_role_grants_to_users", "grants_users", expr="role"),
        _count("total_privilege_grants", "grants_roles", expr="privilege"),
        _count("strong_password_policies", "pwd_policies", _STRONG_PASSWORD),
        _count("active_network_policies", "net_policies", "deleted IS NULL"),
        _count("total_task_runs", "task_hist", expr="run_id"),
        _count("successful_tasks", "task_hist", "state = 'SUCCEEDED'"),
        _count("failed_tasks", "task_hist", "state = 'FAILED'"),
        _pct("task_success_rate", "task_hist", "successful_tasks", "total_task_runs"),
        _sum("total_serverless_credits", "serverless_task", "credits_used"),
        _sum("total_pipe_credits", "pipe_usage", "credits_used"),
        _sum("total_files_inserted", "pipe_usage", "files_inserted"),
        _sum("total_bytes_inserted", "pipe_usage", "bytes_inserted"),
        _sum("total_clustering_credits", "clustering", "credits_used"),
        _sum("total_bytes_reclustered", "clustering", "num_bytes_reclustered"),
        _sum("total_mv_credits", "mv_refresh", "credits_used"),
        _count("total_mv_refreshes", "mv_refresh", expr="credits_used"),
        _sum("total_replication_credits", "replication", "credits_used"),
        _sum("total_bytes_replicated", "replication", "bytes_transferred"),
        _sum("total_transfer_bytes", "data_transfer", "bytes_transferred"),
        _avg("avg_running_queries", "wh_load", "avg_running"),
        _avg("avg_queued_load", "wh_load", "avg_queued_load"),
        _sum("total_daily_credits", "metering_daily", "credits_used"),
        _sum("total_compute_credits_daily", "metering_daily", "credits_used_compute"),
    ),
)

VIEWS = {v.name: v for v in (COST_PERFORMANCE, SECURITY_MONITORING, MAINTENANCE)}
