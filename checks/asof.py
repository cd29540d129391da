"""Operators asked for a date in the middle of the data: nothing after ``as_of`` may count."""

from gaugework.operators import cost, performance, quota, security, sizing, users

from checks.registry import R, query, rounded, top
from checks.sizing import _load, _status
from checks.users import SHARE, _rounded_share, _share

MID = "2024-01-15 12:00:00"
M_TS = f"TIMESTAMP '{MID}'"
LINE_MID = "1996-06-15 12:00:00"
LM_TS = f"TIMESTAMP '{LINE_MID}'"

MT, LMT, WM = "metering_history", "line_metering_history", "warehouse_metering_history"
QH, LQ, WL, LH = "query_history", "line_query_history", "warehouse_load_history", "login_history"


def _known(log: str, as_of: str, column: str = "start_time") -> str:
    return f"(SELECT * FROM {log} WHERE {column} <= {as_of})"


@query(
    "credits_month_over_month_mid",
    LMT,
    f"""
    WITH m AS (
        SELECT coalesce(round(sum(CASE WHEN start_time >= TIMESTAMP '1996-06-01' THEN credits_used END), 2), 0) AS c,
               coalesce(round(sum(CASE WHEN start_time < TIMESTAMP '1996-06-01' THEN credits_used END), 2), 0) AS p,
               coalesce(round(sum(CASE WHEN start_time >= {LM_TS} - INTERVAL 7 DAY THEN credits_used END), 2), 0) AS w
        FROM {_known(LMT, LM_TS)} WHERE start_time >= TIMESTAMP '1996-05-01')
    SELECT c AS credits_this_month, p AS credits_last_month, w AS credits_7d,
           CASE WHEN p > 0 THEN {R('(c - p) / p * 100', 6)} END AS delta_pct FROM m""",
)
def _(t):
    return rounded(cost.credits_month_over_month(t(LMT), LINE_MID), 6, "delta_pct")


@query(
    "credits_by_service_mid",
    LMT,
    f"""SELECT service_type, {R('sum(credits_used)', 2)} AS credits FROM {_known(LMT, LM_TS)}
        WHERE start_time >= {LM_TS} - INTERVAL 30 DAY GROUP BY 1""",
)
def _(t):
    return cost.credits_by_service(t(LMT), LINE_MID)


@query(
    "service_share_pct_mid",
    MT,
    f"""SELECT service_type, {R('sum(credits_used)', 2)} AS credits,
               {R('sum(credits_used) * 100.0 / sum(sum(credits_used)) OVER ()', 1)} AS pct
        FROM {_known(MT, M_TS)} WHERE start_time >= {M_TS} - INTERVAL 30 DAY GROUP BY service_type""",
)
def _(t):
    return cost.service_share_pct(t(MT), MID)


@query(
    "serverless_quota_status_mid",
    "serverless_config metering_history",
    _status(
        "service_type",
        "serverless_config",
        f"""SELECT service_type, sum(credits_used) AS used, NULL AS max_time FROM {_known(MT, M_TS)}
            WHERE start_time >= TIMESTAMP '2024-01-15' GROUP BY 1""",
        "EXCEEDED",
    ),
)
def _(t):
    out = quota.quota_status(t("serverless_config"), t(MT), "service_type", quota.SERVICE_TOP, MID)
    return rounded(out, 4, "credits_used", "credits_remaining")


@query(
    "warehouse_quota_status_mid",
    f"event_quota_config {WM}",
    _status(
        "warehouse_name",
        "event_quota_config",
        f"""SELECT warehouse_name, sum(credits_used) AS used, max(end_time) AS max_time FROM {_known(WM, M_TS)}
            WHERE start_time >= TIMESTAMP '2024-01-15' GROUP BY 1""",
        "SUSPENDED",
        extra=f"auto_suspend_at_100, coalesce(max_time, {M_TS}) AS data_as_of,",
    ),
)
def _(t):
    out = quota.quota_status(t("event_quota_config"), t(WM), "warehouse_name", quota.WAREHOUSE_TOP, MID)
    return rounded(out, 4, "credits_used", "credits_remaining")


@query("warehouse_load_mid", WL, _load(_known(WL, M_TS), M_TS))
def _(t):
    return sizing.warehouse_load(t(WL), MID)


@query("user_share_mid", QH, _share(_known(QH, M_TS), M_TS, 30) + SHARE)
def _(t):
    return _rounded_share(users.user_share_by_warehouse(t(QH), MID))


@query(
    "query_volume_24h_mid",
    LQ,
    f"""SELECT count(*) AS total, count(error_code) AS errors FROM {_known(LQ, LM_TS)}
        WHERE start_time >= {LM_TS} - INTERVAL 1 DAY""",
)
def _(t):
    return performance.query_volume_24h(t(LQ), LINE_MID)


@query(
    "failed_logins_daily_mid",
    LH,
    f"""SELECT CAST(event_timestamp AS DATE) AS day, user_name, reported_client_type AS client, client_ip AS ip, error_message,
               count(*) AS attempts
        FROM {_known(LH, M_TS, 'event_timestamp')}
        WHERE is_success = 'NO' AND event_timestamp >= {M_TS} - INTERVAL 7 DAY GROUP BY 1, 2, 3, 4, 5
        {top('attempts DESC', 'day user_name client ip error_message', 30)}""",
)
def _(t):
    return security.failed_logins_daily(t(LH), MID)


@query(
    "login_clients_mid",
    LH,
    f"""SELECT reported_client_type, count(*) AS logins, count(DISTINCT user_name) AS users
        FROM {_known(LH, M_TS, 'event_timestamp')}
        WHERE is_success = 'YES' AND event_timestamp >= {M_TS} - INTERVAL 7 DAY GROUP BY 1""",
)
def _(t):
    return security.login_clients(t(LH), MID)
