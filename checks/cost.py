from pyspark.sql import functions as F

from gaugework.operators import cost as op
from gaugework.operators.reshape import union_all, unpivot

from checks.registry import E_TS, END, EVENTS, L_TS, LINES, PERIOD, R, START, query, rounded

WM, MT, LMT, LWM = (
    "warehouse_metering_history",
    "metering_history",
    "line_metering_history",
    "line_warehouse_metering",
)
DAY_30 = f"start_time >= {E_TS} - INTERVAL 30 DAY"
LINE_30 = f"start_time >= {L_TS} - INTERVAL 30 DAY"


def _by_period(grain: str, digits: int, where: str, log: str = WM) -> str:
    return f"""
        SELECT warehouse_name, CAST(date_trunc('{grain}', start_time) AS TIMESTAMP) AS period,
               {R("sum(credits_used)", digits)} AS credits_used
        FROM {log} WHERE {where} GROUP BY 1, 2"""


@query("credits_by_hour", WM, _by_period("hour", 4, f"start_time {PERIOD}"))
def _(t):
    return op.credits_by_period(t(WM), "hour", START, END)


@query("credits_by_day_and_warehouse", WM, _by_period("day", 4, f"start_time {PERIOD}"))
def _(t):
    return op.credits_by_period(t(WM), "day", START, END)


@query(
    "credits_by_month",
    LWM,
    _by_period("month", 2, "start_time >= TIMESTAMP '2000-11-05 00:00:00'", LWM),
)
def _(t):
    return op.credits_by_period(t(LWM), "month", as_of=LINES)


@query("total_credits_warehouses", WM, f"SELECT {R('coalesce(sum(credits_used), 0)', 4)} AS total FROM {WM} WHERE start_time {PERIOD}")
def _(t):
    return rounded(op.total_credits(t(WM), START, END), 4, "total")


@query(
    "total_credits_serverless",
    MT,
    f"""SELECT {R('coalesce(sum(credits_used), 0)', 4)} AS total FROM {MT}
        WHERE start_time {PERIOD} AND service_type NOT IN ('WAREHOUSE_METERING')""",
)
def _(t):
    return rounded(op.total_credits(t(MT), START, END, exclude=(op.WAREHOUSE_SERVICE,)), 4, "total")


OVERVIEW = f"""
    WITH k AS (
        SELECT (SELECT coalesce(sum(credits_used), 0) FROM {WM} WHERE start_time {PERIOD}) AS w,
               (SELECT coalesce(sum(credits_used), 0) FROM {MT}
                WHERE start_time {PERIOD} AND service_type <> 'WAREHOUSE_METERING') AS s,
               (SELECT count(*) FROM query_history WHERE start_time {PERIOD}) AS q)
"""


@query(
    "overview_kpis",
    f"{WM} {MT} query_history",
    OVERVIEW
    + f"""SELECT {R('w', 4)} AS warehouse_credits, {R('s', 4)} AS serverless_credits, q AS total_queries,
                 {R('w + s', 4)} AS total_credits, {R('(w + s) * 4', 4)} AS total_cost FROM k""",
)
def _(t):
    out = op.overview_kpis(t(WM), t(MT), t("query_history"), START, END)
    return rounded(out, 4, "warehouse_credits", "serverless_credits", "total_credits", "total_cost")


@query(
    "category_split",
    f"{WM} {MT} query_history",
    OVERVIEW
    + f"""SELECT 'Warehouses' AS category, {R('w', 4)} AS credits FROM k WHERE w + s > 0
          UNION ALL SELECT 'Serverless', {R('s', 4)} FROM k WHERE w + s > 0""",
)
def _(t):
    kpis = op.overview_kpis(t(WM), t(MT), t("query_history"), START, END)
    return rounded(op.category_split(kpis), 4, "credits")


@query(
    "hourly_by_category",
    f"{WM} {MT}",
    f"""
    SELECT period, 'Warehouse' AS category, {R('sum(c)', 4)} AS credits_used
    FROM (SELECT warehouse_name, date_trunc('hour', start_time) AS period, round(sum(credits_used), 4) AS c
          FROM {WM} WHERE start_time {PERIOD} GROUP BY 1, 2) GROUP BY period
    UNION ALL
    SELECT date_trunc('hour', start_time), 'Serverless', {R('sum(credits_used)', 4)}
    FROM {MT} WHERE start_time {PERIOD} AND service_type <> 'WAREHOUSE_METERING' GROUP BY 1""",
)
def _(t):
    return rounded(op.hourly_by_category(t(WM), t(MT), START, END), 4, "credits_used")


@query(
    "service_hourly",
    MT,
    f"""SELECT date_trunc('hour', start_time) AS period, {R('sum(credits_used)', 4)} AS credits_used
        FROM {MT} WHERE start_time {PERIOD} AND service_type = 'CLICK' GROUP BY 1""",
)
def _(t):
    return op.service_hourly(t(MT), "CLICK", START, END)


@query(
    "service_total",
    MT,
    f"""SELECT {R('sum(c)', 4)} AS total, {R('sum(c) * 4', 4)} AS total_cost FROM (
        SELECT date_trunc('hour', start_time) AS h, round(sum(credits_used), 4) AS c
        FROM {MT} WHERE start_time {PERIOD} AND service_type = 'CLICK' GROUP BY 1)""",
)
def _(t):
    return rounded(op.service_total(t(MT), "CLICK", START, END), 4, "total", "total_cost")


@query(
    "service_types",
    MT,
    f"SELECT DISTINCT service_type FROM {MT} WHERE start_time {PERIOD} AND service_type <> 'WAREHOUSE_METERING'",
)
def _(t):
    return op.service_types(t(MT), START, END)


TOP_SERVICES = f"""
    SELECT service_type, {R('sum(credits_used)', 2)} AS total_credits, count(*) AS periods_active
    FROM {MT} WHERE {DAY_30} AND service_type <> 'WAREHOUSE_METERING' GROUP BY 1
    ORDER BY total_credits DESC LIMIT 50"""


@query("serverless_top_consumers", MT, TOP_SERVICES)
def _(t):
    return op.serverless_top_consumers(t(MT), EVENTS)


@query("serverless_top_consumers_one", MT, f"SELECT * FROM ({TOP_SERVICES}) WHERE service_type = 'PURCHASE'")
def _(t):
    return op.serverless_top_consumers(t(MT), EVENTS, service="PURCHASE")


@query(
    "serverless_daily_trend",
    MT,
    f"""SELECT date_trunc('day', start_time)::TIMESTAMP AS day_date, service_type, {R('sum(credits_used)', 4)} AS credits_used
        FROM {MT} WHERE start_time >= TIMESTAMP '2023-12-31 00:00:00' AND service_type <> 'WAREHOUSE_METERING'
        GROUP BY 1, 2""",
)
def _(t):
    return op.serverless_daily_trend(t(MT), EVENTS)


@query(
    "warehouse_cost",
    WM,
    f"""SELECT warehouse_name, {R('sum(credits_used)', 2)} AS total_credits,
               {R('sum(credits_used) * 4', 2)} AS estimated_cost_usd, count(*) AS metering_events
        FROM {WM} WHERE start_time {PERIOD} GROUP BY 1""",
)
def _(t):
    return op.warehouse_cost(t(WM), START, END)


@query(
    "credits_month_over_month",
    LMT,
    f"""
    WITH m AS (
        SELECT coalesce(round(sum(CASE WHEN start_time >= TIMESTAMP '2001-11-01' THEN credits_used END), 2), 0) AS c,
               coalesce(round(sum(CASE WHEN start_time < TIMESTAMP '2001-11-01' THEN credits_used END), 2), 0) AS p,
               coalesce(round(sum(CASE WHEN start_time >= {L_TS} - INTERVAL 7 DAY THEN credits_used END), 2), 0) AS w
        FROM {LMT} WHERE start_time >= TIMESTAMP '2001-10-01')
    SELECT c AS credits_this_month, p AS credits_last_month, w AS credits_7d,
           CASE WHEN p > 0 THEN {R('(c - p) / p * 100', 6)} END AS delta_pct FROM m""",
)
def _(t):
    return rounded(op.credits_month_over_month(t(LMT), LINES), 6, "delta_pct")


@query(
    "credits_by_service",
    LMT,
    f"SELECT service_type, {R('sum(credits_used)', 2)} AS credits FROM {LMT} WHERE {LINE_30} GROUP BY 1",
)
def _(t):
    return op.credits_by_service(t(LMT), LINES)


@query(
    "service_share_pct",
    MT,
    f"""SELECT service_type, {R('sum(credits_used)', 2)} AS credits,
               {R('sum(credits_used) * 100.0 / sum(sum(credits_used)) OVER ()', 1)} AS pct
        FROM {MT} WHERE {DAY_30} GROUP BY service_type""",
)
def _(t):
    return op.service_share_pct(t(MT), EVENTS)


@query(
    "credits_by_day",
    MT,
    f"SELECT CAST(start_time AS DATE) AS day, {R('sum(credits_used)', 3)} AS credits FROM {MT} WHERE {DAY_30} GROUP BY 1",
)
def _(t):
    return op.credits_by_day(t(MT), EVENTS)


@query(
    "credits_by_day_service",
    MT,
    f"""SELECT CAST(start_time AS DATE) AS day, service_type, {R('sum(credits_used)', 3)} AS credits
        FROM {MT} WHERE {DAY_30} GROUP BY 1, 2""",
)
def _(t):
    return op.credits_by_day_service(t(MT), EVENTS)


@query(
    "warehouse_usage",
    WM,
    f"""SELECT warehouse_name, {R('sum(credits_used)', 2)} AS total_credits,
               {R('avg(credits_used)', 4)} AS avg_credits_per_hour,
               count(DISTINCT date_trunc('day', start_time)) AS days_active
        FROM {WM} WHERE {DAY_30} GROUP BY 1""",
)
def _(t):
    return op.warehouse_usage(t(WM), EVENTS)


@query(
    "warehouse_daily_rate",
    LWM,
    f"""SELECT warehouse_name, {R('sum(credits_used)', 2)} AS total_credits,
               count(DISTINCT date_trunc('day', start_time)) AS active_days,
               {R("sum(credits_used) / nullif(count(DISTINCT date_trunc('day', start_time)), 0)", 2)} AS credits_per_day
        FROM {LWM} WHERE {LINE_30} GROUP BY 1""",
)
def _(t):
    return op.warehouse_daily_rate(t(LWM), LINES)


@query(
    "project_warehouse_credits",
    WM,
    f"""SELECT CAST(start_time AS DATE) AS day, {R('sum(credits_used_compute)', 4)} AS credits_compute,
               {R('sum(credits_used_cloud_services)', 4)} AS credits_cloud
        FROM {WM} WHERE warehouse_name = 'purchase' AND start_time >= {E_TS} - INTERVAL 7 DAY GROUP BY 1""",
)
def _(t):
    return op.project_warehouse_credits(t(WM), "purchase", EVENTS)


_HOURS = ", ".join(
    R(f"coalesce(sum(CASE WHEN hour(p) = {h} THEN c END), 0)", 4) + f" AS h{h}" for h in range(24)
)


@query(
    "pivot_hours",
    WM,
    f"""SELECT warehouse_name, {_HOURS}
        FROM (SELECT warehouse_name, date_trunc('hour', start_time) AS p, round(sum(credits_used), 4) AS c
              FROM {WM} WHERE start_time {PERIOD} GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return rounded(op.pivot_hours(t(WM), START, END), 4, *[f"h{i}" for i in range(24)])


@query(
    "union_all",
    f"{WM} {LMT}",
    f"""SELECT warehouse_name, start_time, credits_used, NULL AS service_type FROM {WM}
        UNION ALL SELECT NULL, start_time, credits_used, service_type FROM {LMT}""",
)
def _(t):
    return union_all(t(WM).select("warehouse_name", "start_time", "credits_used"), t(LMT))


@query(
    "unpivot",
    WM,
    " UNION ALL ".join(
        f"SELECT warehouse_name, '{c}' AS metric, {R(f'sum(credits_used{c})', 4)} AS value FROM {WM} GROUP BY 1"
        for c in ("_compute", "_cloud_services")
    ),
)
def _(t):
    wide = t(WM).groupBy("warehouse_name").agg(
        F.sum("credits_used_compute").alias("_compute"), F.sum("credits_used_cloud_services").alias("_cloud_services")
    )
    return rounded(unpivot(wide, ["warehouse_name"], ["_compute", "_cloud_services"]), 4, "value")
