from gaugework.operators import governance, security as op, sizing

from checks.registry import E_TS, END, EVENTS, O_TS, ORDERS, PERIOD, R, START, query, rounded, top

LH, US, GU, GR, RL = "login_history", "users", "grants_to_users", "grants_to_roles", "roles"
E_7 = f"event_timestamp >= {E_TS} - INTERVAL 7 DAY"
LIVE = "deleted_on IS NULL"


@query(
    "failed_logins",
    LH,
    f"""SELECT user_name, client_ip, reported_client_type, error_message, count(*) AS failed_attempts,
               min(event_timestamp) AS first_attempt, max(event_timestamp) AS last_attempt
        FROM {LH} WHERE is_success = 'NO' AND event_timestamp {PERIOD} GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return op.failed_logins(t(LH), START, END)


@query(
    "failed_logins_total",
    LH,
    f"SELECT count(*) AS total_failed FROM {LH} WHERE is_success = 'NO' AND event_timestamp {PERIOD}",
)
def _(t):
    return op.failed_logins_total(t(LH), START, END)


@query(
    "failed_logins_daily",
    LH,
    f"""SELECT CAST(event_timestamp AS DATE) AS day, user_name, reported_client_type AS client, client_ip AS ip, error_message,
               count(*) AS attempts
        FROM {LH} WHERE is_success = 'NO' AND {E_7} GROUP BY 1, 2, 3, 4, 5
        {top('attempts DESC', 'day user_name client ip error_message', 30)}""",
)
def _(t):
    return op.failed_logins_daily(t(LH), EVENTS)


LOGIN = "event_timestamp user_name client_ip reported_client_type first_authentication_factor is_success error_message"
NEWEST = f"""SELECT {LOGIN.replace(' ', ', ')} FROM {LH} WHERE event_timestamp {PERIOD}
             {top('event_timestamp DESC', LOGIN, 500)}"""


@query("login_history", LH, NEWEST)
def _(t):
    return op.login_history(t(LH), START, END)


@query(
    "login_kpis",
    LH,
    f"""SELECT count(*) AS total, count(CASE WHEN is_success = 'YES' THEN 1 END) AS succeeded,
               count(CASE WHEN is_success = 'NO' THEN 1 END) AS failed
        FROM {LH} WHERE event_timestamp {PERIOD}""",
)
def _(t):
    return op.login_kpis(t(LH), START, END)


@query(
    "login_clients",
    LH,
    f"""SELECT reported_client_type, count(*) AS logins, count(DISTINCT user_name) AS users
        FROM {LH} WHERE is_success = 'YES' AND {E_7} GROUP BY 1""",
)
def _(t):
    return op.login_clients(t(LH), EVENTS)


@query(
    "brute_force_candidates",
    LH,
    f"""SELECT client_ip, user_name, count(*) AS failed_attempts, min(event_timestamp) AS first_attempt,
               max(event_timestamp) AS last_attempt
        FROM {LH} WHERE is_success = 'NO' AND event_timestamp >= {E_TS} - INTERVAL 30 DAY GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(t):
    return op.brute_force_candidates(t(LH), EVENTS, min_failed=2, days=30)


@query(
    "failing_addresses",
    LH,
    f"""SELECT client_ip, count(*) AS failed_attempts, count(DISTINCT user_name) AS users
        FROM {LH} WHERE is_success = 'NO' AND {E_7} GROUP BY 1 ORDER BY failed_attempts DESC, client_ip LIMIT 20""",
)
def _(t):
    return op.failing_addresses(t(LH), EVENTS)


def _n(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


@query(
    "user_posture",
    US,
    f"""SELECT count(*) AS total_users, {_n('has_password')} AS with_password, {_n('has_rsa_public_key')} AS with_keypair,
               {_n('ext_authn_duo')} AS with_mfa, {_n('disabled')} AS disabled_users,
               {_n(f'last_success_login < {O_TS} - INTERVAL 30 DAY OR last_success_login IS NULL')} AS inactive_30d
        FROM {US} WHERE {LIVE}""",
)
def _(t):
    return op.user_posture(t(US), ORDERS)


@query("users_without_mfa", US, f"SELECT name, email, default_role FROM {US} WHERE {LIVE} AND has_mfa = false")
def _(t):
    return op.users_without_mfa(t(US))


@query(
    "stale_users",
    US,
    f"""SELECT name, email, default_role, last_success_login,
               CAST(date_diff('day', CAST(last_success_login AS DATE), DATE '2001-08-02') AS INTEGER) AS days_since_login,
               has_password, ext_authn_duo AS has_mfa
        FROM {US} WHERE {LIVE} AND disabled = false
          AND (last_success_login < {O_TS} - INTERVAL 90 DAY OR last_success_login IS NULL)
        ORDER BY last_success_login ASC NULLS FIRST, name LIMIT 30""",
)
def _(t):
    return op.stale_users(t(US), ORDERS)


EXPOSED = f"""
    FROM {US} u JOIN {GU} g ON g.grantee_name = u.name
    WHERE u.deleted_on IS NULL AND u.disabled = false AND u.ext_authn_duo = false
      AND g.role IN ('ACCOUNTADMIN', 'SYSADMIN', 'SECURITYADMIN') AND g.deleted_on IS NULL"""


@query(
    "privileged_without_mfa",
    f"{US} {GU}",
    f"""SELECT DISTINCT u.name AS user_name, u.email, u.default_role, u.last_success_login, u.has_password,
               g.role AS privileged_role {EXPOSED}""",
)
def _(t):
    return op.privileged_without_mfa(t(US), t(GU))


@query("privileged_without_mfa_count", f"{US} {GU}", f"SELECT count(DISTINCT u.name) AS cnt {EXPOSED}")
def _(t):
    return op.privileged_without_mfa_count(t(US), t(GU))


@query("role_inventory", RL, f"SELECT name AS role_name, created_on, comment FROM {RL} WHERE {LIVE}")
def _(t):
    return op.role_inventory(t(RL))


@query("role_count", RL, f"SELECT count(*) AS roles FROM {RL} WHERE {LIVE}")
def _(t):
    return op.role_count(t(RL))


def _grants(roles: str) -> str:
    return f"""SELECT grantee_name AS user_name, role, created_on AS granted_on, granted_by FROM {GU}
               WHERE role IN ({roles}) AND {LIVE}"""


@query("admin_grants", GU, _grants("'ACCOUNTADMIN'"))
def _(t):
    return op.admin_grants(t(GU))


@query("other_admin_grants", GU, _grants("'SYSADMIN', 'SECURITYADMIN'"))
def _(t):
    return op.admin_grants(t(GU), op.OTHER_ADMINS)


@query(
    "admin_grants_check",
    GU,
    f"SELECT count(*) AS holders, count(*) > 3 AS too_many FROM {GU} WHERE role = 'ACCOUNTADMIN' AND {LIVE}",
)
def _(t):
    return op.admin_grants_check(t(GU))


GRANT = "created_on privilege object_type object_name granted_to granted_by"


@query(
    "recent_grants",
    GR,
    f"""SELECT created_on, privilege, granted_on AS object_type, name AS object_name, grantee_name AS granted_to, granted_by
        FROM {GR} WHERE created_on >= {O_TS} - INTERVAL 7 DAY AND {LIVE} {top('created_on DESC', GRANT, 50)}""",
)
def _(t):
    return op.recent_grants(t(GR), ORDERS)


@query(
    "network_policy_inventory",
    "network_policies",
    "SELECT name, owner, comment, allowed_ip_list, blocked_ip_list FROM network_policies",
)
def _(t):
    return op.network_policy_inventory(t("network_policies"))


@query("share_inventory", "shares", "SELECT name AS share_name, owner, comment FROM shares")
def _(t):
    return op.share_inventory(t("shares"))


@query(
    "masking_policy_inventory",
    "masking_policies",
    "SELECT policy_name, created, policy_owner FROM masking_policies WHERE deleted IS NULL",
)
def _(t):
    return op.policy_inventory(t("masking_policies"))


@query(
    "row_access_policy_inventory",
    "row_access_policies",
    "SELECT policy_name, created, policy_owner FROM row_access_policies WHERE deleted IS NULL",
)
def _(t):
    return op.policy_inventory(t("row_access_policies"))


POLICIES = "network_policies masking_policies row_access_policies shares"


@query(
    "policy_counts",
    POLICIES,
    """SELECT 'network' AS policy_kind, count(*) AS policies FROM network_policies
       UNION ALL SELECT 'masking', count(*) FROM masking_policies WHERE deleted IS NULL
       UNION ALL SELECT 'row_access', count(*) FROM row_access_policies WHERE deleted IS NULL
       UNION ALL SELECT 'shares', count(*) FROM shares""",
)
def _(t):
    return op.policy_counts(
        network=t("network_policies"),
        masking=t("masking_policies"),
        row_access=t("row_access_policies"),
        shares=t("shares"),
    )


# ---- scorecard -------------------------------------------------------------------------

ENABLED = f"{LIVE} AND disabled = false"
STALE = f"last_success_login < {O_TS} - INTERVAL 90 DAY OR last_success_login IS NULL"


def _check(category: str, control: str, value: str, good: str, other: str, detail: str) -> str:
    return f"""SELECT '{category}' AS category, '{control}' AS control, CASE WHEN {good} THEN 'OK' ELSE '{other}' END AS status,
                      CAST(v AS DOUBLE) AS value, CAST(v AS VARCHAR) || ' {detail}' AS detail FROM (SELECT {value})"""


SCORECARD = " UNION ALL ".join(
    [
        f"""SELECT 'security' AS category, 'mfa_enabled' AS control,
                   CASE WHEN p > 80 THEN 'OK' WHEN p > 50 THEN 'WARN' ELSE 'CRITICAL' END AS status, {R('p', 1)} AS value,
                   CAST({R('p', 1)} AS VARCHAR) || ' % of enabled users with MFA' AS detail
            FROM (SELECT count(*) AS n, {_n('ext_authn_duo')} * 100.0 / count(*) AS p FROM {US} WHERE {ENABLED}) WHERE n > 0""",
        _check("security", "network_policy", "count(*) AS v FROM network_policies", "v > 0", "CRITICAL", "network policies"),
        _check("security", "admins_without_mfa", f"count(DISTINCT u.name) AS v {EXPOSED}", "v = 0", "CRITICAL", "privileged users without MFA"),
        _check("rbac", "top_admin_count", f"count(*) AS v FROM {GU} WHERE role = 'ACCOUNTADMIN' AND {LIVE}", "v <= 3", "WARN", "holders of the top admin role"),
        _check("finops", "resource_monitors", "count(*) AS v FROM resource_monitors", "v > 0", "WARN", "resource monitors"),
        _check(
            "warehouse", "auto_suspend",
            "count(*) AS v FROM warehouse_settings WHERE TRY_CAST(auto_suspend AS DOUBLE) IS NULL OR TRY_CAST(auto_suspend AS DOUBLE) > 600",
            "v = 0", "WARN", "warehouses without auto-suspend within 600 s",
        ),
        _check("rbac", "stale_users", f"count(*) AS v FROM {US} WHERE {ENABLED} AND ({STALE})", "v = 0", "WARN", "users without a login for 90 days"),
        _check("data_protection", "masking_policies", "count(*) AS v FROM masking_policies WHERE deleted IS NULL", "v > 0", "INFO", "masking policies"),
        _check("data_protection", "row_access_policies", "count(*) AS v FROM row_access_policies WHERE deleted IS NULL", "v > 0", "INFO", "row access policies"),
        _check(
            "warehouse", "remote_spill",
            f"""count(DISTINCT warehouse_name) AS v FROM line_query_history
                WHERE start_time >= {O_TS} - INTERVAL 30 DAY AND bytes_spilled_to_remote_storage > 0""",
            "v = 0", "CRITICAL", "warehouses with remote spill",
        ),
    ]
)
SCORE_LOGS = (
    f"{US} {GU} resource_monitors warehouse_settings network_policies masking_policies row_access_policies line_query_history"
)


def _scorecard(t):
    return governance.compliance_scorecard(
        t(US),
        t(GU),
        t("resource_monitors"),
        sizing.normalize_warehouse_settings(t("warehouse_settings")),
        t("network_policies"),
        t("masking_policies"),
        t("row_access_policies"),
        t("line_query_history"),
        ORDERS,
    )


query("compliance_scorecard", SCORE_LOGS, SCORECARD)(_scorecard)

CLASSES = f"""{_n("status = 'OK'")} AS ok, {_n("status IN ('WARN', 'INFO')")} AS warn, {_n("status = 'CRITICAL'")} AS critical,
              count(*) AS total"""


@query("compliance_score", SCORE_LOGS, f"""SELECT {CLASSES}, {R(_n("status = 'OK'") + ' / count(*)', 6)} AS ratio FROM ({SCORECARD})""")
def _(t):
    return rounded(governance.compliance_score(_scorecard(t)), 6, "ratio")


@query("compliance_by_category", SCORE_LOGS, f"SELECT category, {CLASSES} FROM ({SCORECARD}) GROUP BY 1")
def _(t):
    return governance.compliance_by_category(_scorecard(t))


@query(
    "health_context",
    f"{LH} warehouse_metering_history {US}",
    f"""SELECT '{{"failed_logins_24h":' || (SELECT count(*) FROM {LH}
                   WHERE event_timestamp > {E_TS} - INTERVAL 24 HOUR AND is_success = 'NO')
            || coalesce(',"credits_used_today":' || (SELECT {R('sum(credits_used)', 2)} FROM warehouse_metering_history
                   WHERE start_time >= TIMESTAMP '2024-01-30'), '')
            || ',"total_users":' || (SELECT count(*) FROM {US} WHERE {LIVE})
            || ',"users_without_mfa":' || (SELECT count(*) FROM {US} WHERE {LIVE} AND has_mfa = false) || '}}' AS ctx""",
)
def _(t):
    return governance.health_context(t(LH), t("warehouse_metering_history"), t(US), EVENTS)
