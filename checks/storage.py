from gaugework.operators import filters
from gaugework.operators import storage as op

from checks.registry import L_TS, LINES, ORDERS, R, query, rounded, top

TB, GB = "1099511627776.0", "1073741824.0"
ST, SS = "storage_usage", "stage_storage_usage_history"
TOTAL = "storage_bytes + stage_bytes + failsafe_bytes"
O_START, O_END = "2001-07-01 00:00:00", "2001-08-01 23:59:00"
O_PERIOD = f"BETWEEN TIMESTAMP '{O_START}' AND TIMESTAMP '{O_END}'"


def _storage(where: str) -> str:
    return f"""
        SELECT usage_date AS usage_day, {R(f'avg({TOTAL}) / {TB}', 4)} AS total_tb,
               {R(f'avg(storage_bytes) / {TB}', 4)} AS storage_tb, {R(f'avg(stage_bytes) / {TB}', 4)} AS stage_tb,
               {R(f'avg(failsafe_bytes) / {TB}', 4)} AS failsafe_tb
        FROM {ST} WHERE {where} GROUP BY 1"""


@query("storage_by_day", ST, _storage("usage_date >= DATE '2001-10-06'"))
def _(t):
    return op.storage_by_day(t(ST), as_of=LINES)


@query("storage_by_day_period", ST, _storage("usage_date BETWEEN DATE '2001-01-01' AND DATE '2001-01-31'"))
def _(t):
    return op.storage_by_day(t(ST), "2001-01-01 10:00:00", "2001-01-31 09:00:00")


AVG_7D = f"""
    WITH a AS (SELECT {R(f'avg(storage_bytes) / {TB}', 3)} AS t, {R(f'avg(stage_bytes) / {TB}', 3)} AS s,
                      {R(f'avg(failsafe_bytes) / {TB}', 3)} AS f
               FROM {ST} WHERE usage_date >= CAST({L_TS} AS DATE) - INTERVAL 7 DAY)
"""


@query(
    "storage_avg_7d",
    ST,
    AVG_7D
    + f"SELECT t AS table_tb, s AS stage_tb, f AS failsafe_tb, {R('coalesce(t, 0) + coalesce(s, 0) + coalesce(f, 0)', 6)} AS total_tb FROM a",
)
def _(t):
    return rounded(op.storage_avg_7d(t(ST), LINES), 6, "total_tb")


@query(
    "storage_split",
    ST,
    AVG_7D
    + """SELECT 'Tables' AS type, coalesce(t, 0) AS tb FROM a UNION ALL SELECT 'Stages', coalesce(s, 0) FROM a
         UNION ALL SELECT 'Fail-safe', coalesce(f, 0) FROM a""",
)
def _(t):
    return op.storage_split(t(ST), LINES)


@query(
    "storage_growth",
    ST,
    f"""
    WITH d AS (SELECT usage_date, {R(f'avg({TOTAL}) / {TB}', 4)} AS tb FROM {ST}
               WHERE usage_date >= DATE '2001-10-06' GROUP BY 1),
         e AS (SELECT min(usage_date) AS a, max(usage_date) AS b FROM d),
         v AS (SELECT a, b, (SELECT tb FROM d WHERE usage_date = a) AS x, (SELECT tb FROM d WHERE usage_date = b) AS y FROM e)
    SELECT a AS first_day, b AS last_day, x AS first_tb, y AS last_tb, {R('y - x', 4)} AS growth_tb,
           {R('(y - x) * 100 / x', 2)} AS growth_pct FROM v""",
)
def _(t):
    return op.storage_growth(t(ST), LINES)


LOAD_COLS = "pipe_name file_name stage_location last_load_time row_count row_parsed error_count status"
LOADED = f"""
    SELECT {LOAD_COLS.replace(' ', ', ')} FROM copy_history WHERE last_load_time {O_PERIOD}
    {top('last_load_time DESC NULLS LAST', LOAD_COLS, 200)}"""


@query("load_history", "copy_history", LOADED)
def _(t):
    return op.load_history(t("copy_history"), O_START, O_END)


@query(
    "load_kpis",
    "copy_history",
    f"""SELECT count(*) AS loads, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows,
               CAST(coalesce(sum(error_count), 0) AS BIGINT) AS errors
        FROM copy_history WHERE last_load_time {O_PERIOD}""",
)
def _(t):
    return op.load_kpis(t("copy_history"), O_START, O_END)


TABLE_COLS = "table_catalog table_schema table_name row_count bytes created last_altered"
LARGEST = f"""
    SELECT table_catalog AS database_name, table_schema AS schema_name, table_name, row_count,
           {R(f'bytes / {GB}', 4)} AS size_gb, created, last_altered
    FROM (SELECT {TABLE_COLS.replace(' ', ', ')} FROM tables
          WHERE deleted IS NULL AND bytes > 0 AND table_type = 'BASE TABLE'
          {top('bytes DESC NULLS LAST', TABLE_COLS, 50)})"""


@query("largest_tables", "tables", LARGEST)
def _(t):
    return op.largest_tables(t("tables"))


@query(
    "largest_tables_kpis",
    "tables",
    f"""SELECT {R('coalesce(sum(size_gb), 0)', 4)} AS total_gb, count(*) AS tables,
               CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows
        FROM (SELECT row_count, {R(f'bytes / {GB}', 4)} AS size_gb FROM tables
              WHERE deleted IS NULL AND bytes > 0 AND table_type = 'BASE TABLE')""",
)
def _(t):
    return rounded(op.largest_tables_kpis(t("tables")), 4, "total_gb")


STAGES = """
    SELECT stage_catalog AS database_name, stage_schema AS schema_name, stage_name, stage_type, stage_url, created,
           last_altered, stage_owner
    FROM stages WHERE deleted IS NULL ORDER BY stage_name LIMIT 100"""


@query("stage_inventory", "stages", STAGES)
def _(t):
    return op.stage_inventory(t("stages"))


@query("stage_type_counts", "stages", 'SELECT stage_type, count(*) AS "count" FROM stages WHERE deleted IS NULL AND stage_type IS NOT NULL GROUP BY 1')
def _(t):
    return op.stage_type_counts(t("stages"))


@query(
    "stage_kpis",
    "stages",
    f"""SELECT count(*) AS stages, count(CASE WHEN stage_type ILIKE '%internal%' THEN 1 END) AS internal,
               count(CASE WHEN stage_type ILIKE '%external%' THEN 1 END) AS external FROM stages WHERE deleted IS NULL""",
)
def _(t):
    return op.stage_kpis(t("stages"))


@query(
    "stage_storage_recent",
    SS,
    f"""SELECT usage_date, average_stage_bytes FROM {SS} WHERE usage_date >= DATE '2001-08-01'
        ORDER BY average_stage_bytes DESC NULLS LAST, usage_date LIMIT 50""",
)
def _(t):
    return op.stage_storage_recent(t(SS), ORDERS)


# ---- filters as such -------------------------------------------------------------


@query("period_filter", "copy_history", f"SELECT * FROM copy_history WHERE last_load_time {O_PERIOD}")
def _(t):
    return filters.period_filter(t("copy_history"), "last_load_time", O_START, O_END)


@query(
    "lookback",
    "task_history",
    "SELECT * FROM task_history WHERE scheduled_time >= TIMESTAMP '2001-05-02 00:00:00'",
)
def _(t):
    return filters.lookback(t("task_history"), "scheduled_time", 3, "month", ORDERS)


@query(
    "distinct_warehouses",
    "line_warehouse_metering",
    "SELECT DISTINCT warehouse_name FROM line_warehouse_metering WHERE warehouse_name IS NOT NULL",
)
def _(t):
    return filters.distinct_values(t("line_warehouse_metering"), "warehouse_name")
