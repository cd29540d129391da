from pyspark.sql import functions as F

from gaugework.operators import users as op

from checks.registry import E_TS, EVENTS, L_TS, LINES, R, query, rounded

QH, LQ = "query_history", "line_query_history"


def _share(log: str, as_of: str, days: int, warehouses: str = "") -> str:
    """Users ranked by a window over their totals; shares by a window over the warehouse."""
    return f"""
    WITH spent AS (
        SELECT warehouse_name, user_name, sum(total_elapsed_time) AS ms FROM {log}
        WHERE start_time >= {as_of} - INTERVAL {days} DAY {warehouses} GROUP BY ALL),
    placed AS (
        SELECT user_name AS name, row_number() OVER (ORDER BY sum(ms) DESC, user_name NULLS LAST) AS place
        FROM spent GROUP BY user_name),
    shares AS (
        SELECT warehouse_name, coalesce(p.name, 'Other') AS user_name, sum(ms) / 60000.0 AS total_min,
               sum(ms) / nullif(sum(sum(ms)) OVER (PARTITION BY warehouse_name), 0) AS share
        FROM spent s LEFT JOIN placed p ON p.name = s.user_name AND p.place <= 8
        WHERE warehouse_name IS NOT NULL GROUP BY 1, 2
        QUALIFY sum(sum(ms)) OVER (PARTITION BY warehouse_name) > 0)
    """


SHARE = f"""SELECT warehouse_name, user_name, {R('total_min', 4)} AS total_min, {R('share', 6)} AS share,
                   {R('share * 100', 4)} AS share_pct FROM shares"""


def _rounded_share(df):
    return rounded(rounded(df, 4, "total_min", "share_pct"), 6, "share")


@query("user_share_by_warehouse", QH, _share(QH, E_TS, 30) + SHARE)
def _(t):
    return _rounded_share(op.user_share_by_warehouse(t(QH), EVENTS))


@query("user_share_lines", LQ, _share(LQ, L_TS, 90, "AND warehouse_name IN ('A', 'N')") + SHARE)
def _(t):
    return _rounded_share(op.user_share_by_warehouse(t(LQ), LINES, days=90, warehouses=["A", "N"]))


@query(
    "warehouse_order",
    QH,
    _share(QH, E_TS, 30) + f"SELECT warehouse_name, {R('sum(total_min)', 4)} AS total_min FROM shares GROUP BY 1",
)
def _(t):
    return rounded(op.warehouse_order(op.user_share_by_warehouse(t(QH), EVENTS)), 4, "total_min")


PLACED = f"""
    WITH spent AS (SELECT warehouse_name, user_name, sum(total_elapsed_time) AS ms FROM {QH}
                   WHERE start_time >= {E_TS} - INTERVAL 30 DAY GROUP BY ALL),
    placed AS (SELECT user_name, sum(ms) AS user_ms, row_number() OVER (ORDER BY sum(ms) DESC, user_name NULLS LAST) AS place
               FROM spent GROUP BY user_name HAVING sum(ms) > 0),
    matrix AS (SELECT s.warehouse_name, s.user_name, s.ms / 60000.0 AS total_min, p.place
               FROM spent s JOIN placed p ON p.user_name = s.user_name AND p.place <= 10
               QUALIFY sum(s.ms) OVER (PARTITION BY s.warehouse_name) > 20 * 60000)
    """


@query(
    "top_users_by_time",
    QH,
    PLACED + f"SELECT user_name, {R('user_ms / 60000.0', 4)} AS total_min FROM placed WHERE place <= 10",
)
def _(t):
    return rounded(op.top_users_by_time(t(QH), EVENTS), 4, "total_min")


@query(
    "user_warehouse_matrix",
    QH,
    PLACED + f"SELECT warehouse_name, user_name, {R('total_min', 4)} AS total_min FROM matrix",
)
def _(t):
    return rounded(op.top_user_matrix(t(QH), EVENTS), 4, "total_min")


@query(
    "user_warehouse_matrix_frame",
    QH,
    PLACED + f"SELECT warehouse_name, user_name, {R('total_min', 4)} AS total_min FROM matrix",
)
def _(t):
    qh = t(QH)
    matrix = op.user_warehouse_matrix(qh, EVENTS, op.top_users_by_time(qh, EVENTS))
    return rounded(matrix, 4, "total_min")


_RANKED = ", ".join(
    f"{R(f'coalesce(sum(total_min) FILTER (WHERE place = {i}), 0)', 4)} AS u{i}" for i in range(1, 11)
)


@query("user_warehouse_pivot", QH, PLACED + f"SELECT warehouse_name, {_RANKED} FROM matrix GROUP BY 1")
def _(t):
    # Ten names at most, the result of the top-k; one column per name, named by rank.
    names = [r.user_name for r in op.top_users_by_time(t(QH), EVENTS).collect()]
    wide = op.user_warehouse_pivot(op.user_warehouse_matrix(t(QH), EVENTS, names), names)
    ranked = [
        (F.round(F.col(f"`{names[i]}`"), 4) if i < len(names) else F.lit(0.0)).alias(f"u{i + 1}") for i in range(10)
    ]
    return wide.select("warehouse_name", *ranked)


CONFIG = """SELECT warehouse_name, credit_limit, auto_suspend_at_100, alert_threshold_70, alert_threshold_85,
                   alert_threshold_95, is_active, frequency, array_to_string(alert_emails, ',') AS alert_emails FROM warehouse_config"""
EDITED = f"""
    SELECT warehouse_name, CASE WHEN credit_limit > 18 THEN -1.0 WHEN credit_limit > 8 THEN credit_limit + 0.5 ELSE credit_limit END
             AS credit_limit,
           CASE WHEN frequency = 'WEEKLY' THEN NULL ELSE auto_suspend_at_100 END AS auto_suspend_at_100, alert_threshold_70,
           alert_threshold_85, alert_threshold_95, is_active, frequency,
           CASE WHEN is_active THEN alert_emails ELSE alert_emails || ',new@example.com' END AS alert_emails FROM ({CONFIG})"""
CHANGES = f"""
    SELECT * FROM ({EDITED}) e WHERE NOT EXISTS (
        SELECT 1 FROM ({CONFIG}) s WHERE s.warehouse_name = e.warehouse_name AND s.credit_limit = e.credit_limit
           AND s.auto_suspend_at_100 IS NOT DISTINCT FROM e.auto_suspend_at_100 AND s.alert_threshold_70 = e.alert_threshold_70
           AND s.alert_threshold_85 = e.alert_threshold_85 AND s.alert_threshold_95 = e.alert_threshold_95
           AND s.is_active = e.is_active AND s.frequency = e.frequency
           AND s.alert_emails IS NOT DISTINCT FROM e.alert_emails)"""


def _changes(t):
    stored = t("warehouse_config").select("warehouse_name", *op.EDITABLE)
    limit = F.col("credit_limit")
    edited = stored.withColumns(
        {
            "credit_limit": F.when(limit > 18, -1.0).when(limit > 8, limit + 0.5).otherwise(limit),
            "auto_suspend_at_100": F.when(F.col("frequency") != "WEEKLY", F.col("auto_suspend_at_100")),
            "alert_emails": F.when(F.col("is_active"), F.col("alert_emails")).otherwise(
                F.array_append("alert_emails", F.lit("new@example.com"))
            ),
        }
    )
    return op.config_changes(edited, stored)


def _as_text(df):
    return df.withColumn("alert_emails", F.array_join("alert_emails", ","))


@query("config_changes", "warehouse_config", CHANGES)
def _(t):
    return _as_text(_changes(t))


@query(
    "config_changes_accepted",
    "warehouse_config",
    f"SELECT * REPLACE (CAST(trunc(credit_limit) AS DOUBLE) AS credit_limit) FROM ({CHANGES}) WHERE credit_limit >= 0",
)
def _(t):
    return _as_text(op.accepted_changes(_changes(t)))
