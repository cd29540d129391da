from dataclasses import replace

from pyspark.sql import functions as F

from gaugework.functions import exact_percentiles, ntz, round_to, value_counts
from gaugework.functions.time import preset
from gaugework.operators.reshape import union_all
from gaugework.operators import performance as op
from gaugework.operators import rollups
from gaugework.operators.filters import period_filter
from gaugework.plans.views import SECURITY_MONITORING

from checks.registry import E_TS, END, EVENTS, L_TS, LINES, O_TS, ORDERS, PERIOD, R, START, query, rounded, scratch, top

QH, LQ = "query_history", "line_query_history"
MB, GB = "1048576.0", "1073741824.0"
E_7 = f"start_time >= {E_TS} - INTERVAL 7 DAY"
E_30 = f"start_time >= {E_TS} - INTERVAL 30 DAY"
# The line-item clock, a longer and larger history.
L_START, L_END = "2000-01-01 00:00:00", "2001-12-31 23:59:59"
L_PERIOD = f"BETWEEN TIMESTAMP '{L_START}' AND TIMESTAMP '{L_END}'"


@query("query_count", QH, f"SELECT count(*) AS total FROM {QH} WHERE start_time {PERIOD}")
def _(t):
    return op.query_count(t(QH), START, END)


@query(
    "query_volume_24h",
    QH,
    f"""SELECT count(*) AS total, count(CASE WHEN error_code IS NOT NULL THEN 1 END) AS errors
        FROM {QH} WHERE start_time >= {E_TS} - INTERVAL 1 DAY""",
)
def _(t):
    return op.query_volume_24h(t(QH), EVENTS)


@query(
    "active_users_month",
    QH,
    f"SELECT count(DISTINCT user_name) AS cnt FROM {QH} WHERE start_time >= TIMESTAMP '2024-01-01'",
)
def _(t):
    return op.active_users_month(t(QH), EVENTS)


def _summary(log: str, period: str) -> str:
    return f"""
        SELECT count(*) AS total_queries, {R('avg(total_elapsed_time) / 1000', 2)} AS avg_duration_sec,
               {R('quantile_cont(total_elapsed_time, 0.5) / 1000', 2)} AS median_duration_sec,
               {R('quantile_cont(total_elapsed_time, 0.95) / 1000', 2)} AS p95_duration_sec,
               count(CASE WHEN total_elapsed_time > 60000 THEN 1 END) AS slow_queries
        FROM {log} WHERE start_time {period}"""


@query("perf_summary", QH, _summary(QH, PERIOD))
def _(t):
    return op.perf_summary(t(QH), START, END)


@query("perf_summary_lines", LQ, _summary(LQ, L_PERIOD))
def _(t):
    return op.perf_summary(t(LQ), L_START, L_END)


@query(
    "perf_summary_approx",
    QH,
    f"""SELECT total_queries, avg_duration_sec, slow_queries, true AS median_close, true AS p95_close
        FROM ({_summary(QH, PERIOD)})""",
)
def _(t):
    """Approximate percentiles within 2 % of the exact ones, which SQL knows."""
    exact = op.perf_summary(t(QH), START, END)

    def close(col: str):
        right = exact.select(col).scalar()
        return F.abs(F.col(col) - right) <= right * 0.02 + 0.01

    return op.perf_summary(t(QH), START, END, approx=True).select(
        "total_queries",
        "avg_duration_sec",
        "slow_queries",
        close("median_duration_sec").alias("median_close"),
        close("p95_duration_sec").alias("p95_close"),
    )


@query(
    "active_users_month_approx",
    QH,
    f"SELECT true AS close FROM (SELECT count(*) AS n FROM {QH} WHERE start_time >= TIMESTAMP '2024-01-01')",
)
def _(t):
    """The approximate count within 10 % of the exact one."""
    exact = op.active_users_month(t(QH), EVENTS).scalar()
    approx = op.active_users_month(t(QH), EVENTS, approx=True)
    return approx.select((F.abs(F.col("cnt") - exact) <= exact * 0.1 + 1).alias("close"))


_MONTHS = (("2000-01-01", "2000-06-30"), ("2000-03-15", "2001-02-14"), ("2001-07-01", "2001-07-31"))


def _rollup_sql() -> str:
    parts = [
        f"""SELECT '{start}' AS first_day, total_queries, avg_duration_sec, slow_queries, active AS active_exact,
                   true AS active_close, true AS median_close, true AS p95_close
            FROM ({_summary(LQ, f"BETWEEN TIMESTAMP '{start} 00:00:00' AND TIMESTAMP '{end} 23:59:59'")}),
                 (SELECT count(DISTINCT user_name) AS active FROM {LQ}
                  WHERE start_time BETWEEN TIMESTAMP '{start} 00:00:00' AND TIMESTAMP '{end} 23:59:59')"""
        for start, end in _MONTHS
    ]
    return " UNION ALL ".join(parts)


@query("perf_rollup_periods", LQ, _rollup_sql())
def _(t):
    """Three periods from one stored rollup: counts and mean exact, sketches within their error bounds of the log."""
    path, log = scratch(t.spark, "perf_rollup"), t(LQ)
    rollup = replace(rollups.QUERY_ROLLUP, keys=())
    rollup.write(log, path)
    out = []
    for start, end in _MONTHS:
        whole = (f"{start} 00:00:00", f"{end} 23:59:59")
        told = rollups.perf_summary(rollup.read(t.spark, path, *whole)).first()
        rows = period_filter(log, "start_time", *whole)
        # Where the estimates really stand among the log's values.
        value = F.col("total_elapsed_time") / 1000
        real = rows.agg(
            F.countDistinct("user_name").alias("active_exact"),
            *[
                F.avg(test.cast("double")).alias(f"{name}_{side}")
                for name in ("median", "p95")
                for side, test in (("below", value < told[f"{name}_duration_sec"]), ("upto", value <= told[f"{name}_duration_sec"]))
            ],
        )
        off, bound = 4 * rollups.distinct_error(12), rollups.rank_error(400)
        out.append(
            real.select(
                F.lit(start).alias("first_day"),
                F.lit(told.total_queries).alias("total_queries"),
                round_to(F.lit(told.avg_duration_sec), 2).alias("avg_duration_sec"),
                F.lit(told.slow_queries).alias("slow_queries"),
                "active_exact",
                (F.abs(F.lit(told.active_users) - F.col("active_exact")) <= F.col("active_exact") * off + 1).alias("active_close"),
                *[
                    ((F.col(f"{n}_below") - bound <= p) & (F.col(f"{n}_upto") + bound >= p)).alias(f"{n}_close")
                    for n, p in (("median", 0.5), ("p95", 0.95))
                ],
            )
        )
    return union_all(*out)


@query(
    "login_rollup_by_client",
    "login_history",
    """SELECT reported_client_type, count(*) AS attempts, count(CASE WHEN is_success = 'NO' THEN 1 END) AS failed_login_attempts,
              true AS users_close, true AS ips_close, true AS failing_users_close, true AS failing_ips_close
       FROM login_history GROUP BY 1""",
)
def _(t):
    """Login metrics per client from stored days; distinct counts within four standard errors of the exact ones."""
    path, log = scratch(t.spark, "login_rollup"), t("login_history")
    rollups.LOGIN_ROLLUP.write(log, path)
    stored = rollups.LOGIN_ROLLUP.read(t.spark, path, "1900-01-01", "2999-12-31")
    told = rollups.LOGIN_ROLLUP.answer(stored, by=["reported_client_type"])
    names = {"unique_login_users": "users", "unique_login_ips": "ips", "users_with_login_failures": "failing_users",
             "ips_with_login_failures": "failing_ips"}
    exact = SECURITY_MONITORING.query(t, list(names), ["reported_client_type"])
    both = told.alias("a").join(exact.alias("b"), F.col("a.reported_client_type").eqNullSafe(F.col("b.reported_client_type")))
    off = 4 * rollups.distinct_error(12)
    return both.select(
        "a.reported_client_type",
        F.col("rows").alias("attempts"),
        "failed_login_attempts",
        *[(F.abs(F.col(f"a.{n}") - F.col(f"b.{n}")) <= F.col(f"b.{n}") * off + 1).alias(f"{short}_close") for n, short in names.items()],
    )


@query(
    "percentiles_of_narrow_values",
    "",
    """SELECT l_returnflag, round(quantile_cont(1000 + l_extendedprice / 1e6, 0.5), 9) AS p50,
              round(quantile_cont(1000 + l_extendedprice / 1e6, 0.99), 9) AS p99
       FROM lineitem GROUP BY 1""",
)
def _(t):
    """Exact percentiles of values within a ten-thousandth of each other, which share a few buckets."""
    rows = t.table("lineitem").select("l_returnflag", (1000 + F.col("l_extendedprice") / 1e6).alias("v"))
    found = exact_percentiles(value_counts(rows, ["l_returnflag"], "v"), ["l_returnflag"], "v", {"p50": 0.5, "p99": 0.99})
    return found.select("l_returnflag", F.round("p50", 9).alias("p50"), F.round("p99", 9).alias("p99"))


_PRESETS = {
    "last_hour": ("2024-01-30 22:59:59", "2024-01-30 23:59:59"),
    "last_24h": ("2024-01-29 23:59:59", "2024-01-30 23:59:59"),
    "last_7d": ("2024-01-23 00:00:00", "2024-01-30 23:59:00"),
    "last_30d": ("2023-12-31 00:00:00", "2024-01-30 23:59:00"),
}


@query(
    "period_presets",
    QH,
    " UNION ALL ".join(
        f"""SELECT '{name}' AS preset, TIMESTAMP '{a}' AS period_start, TIMESTAMP '{b}' AS period_end, count(*) AS queries
            FROM {QH} WHERE start_time BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'"""
        for name, (a, b) in _PRESETS.items()
    ),
)
def _(t):
    parts = []
    for name in _PRESETS:
        start, end = preset(name, EVENTS)
        counted = op.query_count(t(QH), start, end)
        parts.append(
            counted.select(
                F.lit(name).alias("preset"), ntz(start).alias("period_start"), ntz(end).alias("period_end"),
                F.col("total").alias("queries"),
            )
        )
    return union_all(*parts)


def _by_day(log: str, where: str) -> str:
    ps = ", ".join(
        f"{R(f'quantile_cont(total_elapsed_time, {p}) / 1000', 1)} AS {n}_sec"
        for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    )
    return f"""
        SELECT CAST(start_time AS DATE) AS day, {R('avg(total_elapsed_time) / 1000', 1)} AS avg_sec, {ps},
               count(*) AS nb_queries
        FROM {log} WHERE {where} AND execution_status = 'SUCCESS' GROUP BY 1"""


@query("perf_by_day", QH, _by_day(QH, E_7))
def _(t):
    return op.perf_by_day(t(QH), EVENTS)


@query("perf_by_day_lines", LQ, _by_day(LQ, "start_time BETWEEN TIMESTAMP '1999-12-25' AND TIMESTAMP '2000-01-01'"))
def _(t):
    return op.perf_by_day(t(LQ), "2000-01-01 00:00:00")


@query(
    "perf_by_day_long",
    QH,
    " UNION ALL ".join(
        f"SELECT day, nb_queries, '{m}' AS metric, {m} AS seconds FROM ({_by_day(QH, E_7)})"
        for m in ("avg_sec", "p50_sec", "p95_sec", "p99_sec")
    ),
)
def _(t):
    return op.perf_by_day_long(t(QH), EVENTS)


def _cut(log: str, where: str, order: str, columns: str, k: int) -> str:
    return f"(SELECT {columns.replace(' ', ', ')} FROM {log} WHERE {where} {top(order, columns, k)})"


def _preview(rows: str) -> str:
    return f"""SELECT query_id, user_name, warehouse_name, {R('total_elapsed_time * 0.001', 2)} AS duration_sec,
                      execution_status, left(query_text, 200) AS query_preview, start_time FROM {rows}"""


@query("preview_queries", QH, _preview(QH))
def _(t):
    return op.preview_queries(t(QH))


SLOW = "query_id user_name warehouse_name total_elapsed_time execution_status query_text start_time"


def _slowest(log: str, period: str) -> str:
    where = f"start_time {period} AND total_elapsed_time > 0"
    return _preview(_cut(log, where, "total_elapsed_time DESC NULLS LAST", SLOW, 50))


@query("slowest_queries", QH, _slowest(QH, PERIOD))
def _(t):
    return op.slowest_queries(t(QH), START, END)


@query("slowest_queries_lines", LQ, _slowest(LQ, L_PERIOD))
def _(t):
    return op.slowest_queries(t(LQ), L_START, L_END)


SPILL = """user_name warehouse_name total_elapsed_time bytes_spilled_to_local_storage bytes_spilled_to_remote_storage
           credits_used_cloud_services query_text"""
NAMED = "warehouse_name IS NOT NULL"


@query(
    "slowest_with_spill",
    QH,
    f"""SELECT user_name, warehouse_name, {R('total_elapsed_time * 0.001', 1)} AS duration_sec,
               {R(f'bytes_spilled_to_local_storage / {MB}', 1)} AS spill_local_mb,
               {R(f'bytes_spilled_to_remote_storage / {MB}', 1)} AS spill_remote_mb,
               {R('credits_used_cloud_services', 5)} AS cloud_credits, left(query_text, 100) AS query_preview
        FROM {_cut(QH, f'{E_7} AND {NAMED}', 'total_elapsed_time DESC NULLS LAST', ' '.join(SPILL.split()), 10)}""",
)
def _(t):
    return op.slowest_with_spill(t(QH), EVENTS)


COSTLY = "query_id user_name warehouse_name total_elapsed_time credits_used_cloud_services bytes_scanned query_text"


def _costly(interval: str) -> str:
    where = f"start_time >= {E_TS} - INTERVAL {interval} AND {NAMED}"
    return f"""SELECT query_id, user_name, warehouse_name, {R('total_elapsed_time * 0.001', 1)} AS duration_sec,
                      {R('credits_used_cloud_services', 5)} AS cloud_credits, {R(f'bytes_scanned / {GB}', 2)} AS gb_scanned,
                      left(query_text, 120) AS query_preview
               FROM {_cut(QH, where, 'credits_used_cloud_services DESC NULLS LAST', COSTLY, 10)}"""


@query("most_expensive_queries", QH, _costly("7 DAY"))
def _(t):
    return op.most_expensive_queries(t(QH), EVENTS)


@query("most_expensive_queries_last_hour", QH, _costly("1 HOUR"))
def _(t):
    return op.most_expensive_queries(t(QH), EVENTS, n=1, unit="hour")


RECENT = "query_id query_text query_type execution_status start_time total_elapsed_time bytes_scanned"
LAST_DAY = f"warehouse_name = 'view' AND start_time >= {E_TS} - INTERVAL 1 DAY"


@query(
    "recent_queries",
    QH,
    f"""SELECT query_id, query_text, query_type, execution_status, start_time,
               {R('total_elapsed_time * 0.001', 2)} AS elapsed_sec, {R('bytes_scanned / 1000000.0', 2)} AS mb_scanned
        FROM {_cut(QH, LAST_DAY, 'start_time DESC', RECENT, 50)}""",
)
def _(t):
    return op.recent_queries(t(QH), "view", EVENTS)


@query(
    "queries_by_user",
    QH,
    f"""SELECT user_name, count(*) AS query_count, {R('avg(total_elapsed_time) / 1000', 2)} AS avg_duration_sec,
               {R('sum(credits_used_cloud_services)', 4)} AS cloud_credits
        FROM {QH} WHERE start_time {PERIOD} GROUP BY 1 ORDER BY query_count DESC, user_name LIMIT 50""",
)
def _(t):
    return op.queries_by_user(t(QH), START, END)


@query(
    "user_activity",
    QH,
    f"""SELECT user_name, count(*) AS nb_queries, {R('avg(total_elapsed_time) / 1000', 1)} AS avg_sec,
               {R(f'sum(bytes_scanned) / {GB}', 2)} AS total_gb_scanned,
               count(CASE WHEN error_code IS NOT NULL THEN 1 END) AS errors
        FROM {QH} WHERE {E_7} GROUP BY 1 ORDER BY nb_queries DESC, user_name LIMIT 15""",
)
def _(t):
    return op.user_activity(t(QH), EVENTS)


def _user_credits(log: str, where: str) -> str:
    return f"""
        SELECT user_name, count(*) AS nb_queries, {R('sum(credits_used_cloud_services)', 4)} AS cloud_credits,
               {R('avg(total_elapsed_time) / 1000', 1)} AS avg_duration_sec,
               {R(f'sum(bytes_scanned) / {GB}', 2)} AS total_gb_scanned
        FROM {log} WHERE {where} AND user_name IS NOT NULL
        GROUP BY 1 ORDER BY cloud_credits DESC NULLS LAST, user_name LIMIT 15"""


@query("user_cloud_credits", QH, _user_credits(QH, E_30))
def _(t):
    return op.user_cloud_credits(t(QH), EVENTS)


@query("user_cloud_credits_lines", LQ, _user_credits(LQ, f"start_time >= {L_TS} - INTERVAL 30 DAY"))
def _(t):
    return op.user_cloud_credits(t(LQ), LINES)


RUNNING = "user_name warehouse_name start_time execution_status query_text"
UNFINISHED = f"start_time >= {E_TS} - INTERVAL 1 HOUR AND execution_status IN ('RUNNING', 'QUEUED')"


@query(
    "running_queries",
    QH,
    f"""SELECT user_name, warehouse_name, date_sub('second', start_time, {E_TS}) AS running_sec, execution_status,
               left(query_text, 120) AS query_preview
        FROM {_cut(QH, UNFINISHED, 'start_time', RUNNING, 20)}""",
)
def _(t):
    return op.running_queries(t(QH), EVENTS)


@query(
    "query_errors",
    QH,
    f"""SELECT user_name, warehouse_name, error_code, error_message, count(*) AS cnt
        FROM {QH} WHERE start_time >= {E_TS} - INTERVAL 1 DAY AND error_code IS NOT NULL
        GROUP BY 1, 2, 3, 4 {top('cnt DESC', 'user_name warehouse_name error_code error_message', 20)}""",
)
def _(t):
    return op.query_errors(t(QH), EVENTS)


FAILED = "query_id user_name warehouse_name error_code error_message start_time"


@query(
    "failed_queries",
    QH,
    f"""SELECT {FAILED.replace(' ', ', ')} FROM {QH} WHERE {E_7} AND execution_status = 'FAIL'
        {top('start_time DESC', FAILED, 50)}""",
)
def _(t):
    return op.failed_queries(t(QH), EVENTS)


@query(
    "activity_heatmap",
    QH,
    f"""SELECT CAST(dayofweek(start_time) AS INTEGER) AS dow, CAST(hour(start_time) AS INTEGER) AS hour, count(*) AS nb,
               CASE dayofweek(start_time) WHEN 0 THEN 'Dim' WHEN 1 THEN 'Lun' WHEN 2 THEN 'Mar' WHEN 3 THEN 'Mer'
                    WHEN 4 THEN 'Jeu' WHEN 5 THEN 'Ven' WHEN 6 THEN 'Sam' END AS day_label
        FROM {QH} WHERE {E_7} GROUP BY ALL""",
)
def _(t):
    return op.activity_heatmap(t(QH), EVENTS)


TASKS = "name database_name schema_name state scheduled_time completed_time return_value error_code error_message"


@query(
    "task_runs",
    "task_history",
    f"""SELECT {TASKS.replace(' ', ', ')} FROM task_history
        WHERE database_name IN ('1-URGENT', '5-LOW') AND scheduled_time >= {O_TS} - INTERVAL 7 DAY
        {top('scheduled_time DESC', TASKS, 100)}""",
)
def _(t):
    return op.task_runs(t("task_history"), ["1-URGENT", "5-LOW"], ORDERS)


CACHE = "query_id user_name warehouse_name percentage_scanned_from_cache bytes_scanned start_time"


@query(
    "low_cache_hit",
    QH,
    f"""SELECT query_id, user_name, warehouse_name, {R('percentage_scanned_from_cache', 6)} AS percentage_scanned_from_cache,
               bytes_scanned, start_time
        FROM (SELECT * FROM {QH} WHERE {E_7} AND percentage_scanned_from_cache IS NOT NULL AND bytes_scanned > 0
              ORDER BY percentage_scanned_from_cache, bytes_scanned DESC, query_id LIMIT 50)""",
)
def _(t):
    return rounded(op.low_cache_hit(t(QH), EVENTS), 6, "percentage_scanned_from_cache")


@query(
    "queued_over_threshold",
    QH,
    f"""SELECT query_id, user_name, warehouse_name, {R('queued_provisioning_time * 0.001', 2)} AS queued_sec, start_time
        FROM {QH} WHERE {E_7} AND queued_provisioning_time > 5000""",
)
def _(t):
    return op.queued_over(t(QH), EVENTS)


@query(
    "avg_execution_by_warehouse",
    QH,
    f"""SELECT warehouse_name, count(*) AS nb_queries, {R('avg(execution_time) / 1000', 2)} AS avg_execution_sec
        FROM {QH} WHERE {E_30} AND warehouse_name IS NOT NULL GROUP BY 1""",
)
def _(t):
    return op.avg_execution(t(QH), EVENTS)


@query(
    "slowest_users",
    LQ,
    f"""SELECT user_name, count(*) AS nb_queries, {R('avg(total_elapsed_time) / 1000', 2)} AS avg_sec,
               {R('max(total_elapsed_time) * 0.001', 2)} AS max_sec
        FROM {LQ} WHERE start_time >= {L_TS} - INTERVAL 90 DAY GROUP BY 1
        ORDER BY avg_sec DESC NULLS LAST, user_name LIMIT 15""",
)
def _(t):
    return op.slowest_users(t(LQ), LINES, days=90)
