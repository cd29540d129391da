from pyspark.sql import functions as F

from gaugework.functions import ntz
from gaugework.operators import control as op
from gaugework.operators.filters import facet_filter
from gaugework.sources import config_value, lookup, scan_control

from checks.registry import query, scratch, top

NOW = "2001-08-02 00:00:00"
PERIOD = "BETWEEN TIMESTAMP '2001-07-01 00:00:00' AND TIMESTAMP '2001-08-01 23:59:00'"
START, END = "2001-07-01 00:00:00", "2001-08-01 23:59:00"


# ---- reading --------------------------------------------------------------------


@query("scan_naming", "naming_convention", "SELECT * FROM naming_convention")
def _(t):
    return scan_control(t("naming_convention"), "naming_convention")


@query("scan_projects", "projects", "SELECT * FROM projects")
def _(t):
    return scan_control(t("projects"), "projects")


@query("scan_roles", "managed_roles", "SELECT * FROM managed_roles")
def _(t):
    return scan_control(t("managed_roles"), "managed_roles")


@query("scan_connections", "external_connections", "SELECT * FROM external_connections")
def _(t):
    return scan_control(t("external_connections"), "external_connections")


@query("scan_config", "account_config", "SELECT * FROM account_config")
def _(t):
    return scan_control(t("account_config"), "account_config")


# Whole rows; the list of addresses is compared as text.
EMAILS = "* REPLACE (array_to_string(alert_emails, ',') AS alert_emails)"


def _emails(df):
    return df.withColumn("alert_emails", F.array_join("alert_emails", ","))


def _stored(t, name):
    """A control table as read, without the columns that its adapter leaves NULL."""
    given = t(name)
    return _emails(scan_control(given, name).select(*given.columns))


@query("scan_warehouse_config", "warehouse_config", f"SELECT {EMAILS} FROM warehouse_config")
def _(t):
    return _stored(t, "warehouse_config")


@query(
    "scan_serverless_config",
    "serverless_config",
    f"SELECT {EMAILS} FROM serverless_config",
)
def _(t):
    return _stored(t, "serverless_config")


@query("lookup_config_value", "account_config", "SELECT 'KEY_7' AS config_key, s_name AS config_value FROM supplier WHERE s_suppkey = 7")
def _(t):
    return config_value(t("account_config"), "KEY_7")


@query("lookup_naming_rule", "naming_convention", "SELECT * FROM naming_convention WHERE layer_code = 'L3' AND enabled")
def _(t):
    return lookup(t("naming_convention"), "layer_code", "L3", enabled_only=True)


@query(
    "inventory_counts",
    "projects managed_roles managed_objects audit_log",
    """SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM managed_roles) AS roles,
              (SELECT count(*) FROM managed_objects) AS objects, (SELECT count(*) FROM audit_log) AS audited_actions""",
)
def _(t):
    return op.inventory_counts(t("projects"), t("managed_roles"), t("managed_objects"), t("audit_log"))


@query(
    "objects_per_layer",
    "managed_objects",
    """SELECT project_id, count(*) AS total, count(CASE WHEN layer = 'DSI' THEN 1 END) AS dsi,
              count(CASE WHEN layer = 'DSO' THEN 1 END) AS dso FROM managed_objects GROUP BY 1""",
)
def _(t):
    return op.objects_per_layer(t("managed_objects"))


@query("managed_objects", "managed_objects", "SELECT * FROM managed_objects WHERE project_id = 'P3' AND layer = 'DSI'")
def _(t):
    return op.managed_objects(t("managed_objects"), project_id="P3", layer="DSI")


@query(
    "managed_objects_by_facet",
    "managed_objects",
    "SELECT * FROM managed_objects WHERE layer IN ('DSI', 'DSO') AND object_type IN ('A', 'R')",
)
def _(t):
    return facet_filter(t("managed_objects"), layer=["DSI", "DSO"], object_type=["A", "R"])


@query(
    "active_projects",
    "projects",
    "SELECT project_id, project_name, dsi_db, dso_db, wh_size, status FROM projects WHERE status = 'ACTIVE'",
)
def _(t):
    return op.active_projects(t("projects"))


CONNECTORS = ", ".join(op.CONNECTOR_COLUMNS)


@query("connector_listing", "connectors", f"SELECT {CONNECTORS} FROM connectors WHERE project_id = 'P5'")
def _(t):
    return op.connector_listing(t("connectors"), "P5")


@query(
    "connector_listing_active",
    "connectors",
    f"""SELECT {CONNECTORS} FROM connectors
        WHERE project_id = 'P5' AND status = 'ACTIVE' AND external_connector_id IS NOT NULL AND external_connector_id <> ''""",
)
def _(t):
    return op.connector_listing(t("connectors"), "P5", active_only=True)


@query(
    "connection_status",
    "external_connections",
    """SELECT *, CASE status WHEN 'CONNECTED' THEN '✅' WHEN 'ERROR' THEN '❌' WHEN 'PENDING' THEN '🔄' ELSE '❓' END AS symbol
       FROM external_connections""",
)
def _(t):
    return op.connection_status(t("external_connections"))


# ---- logs ------------------------------------------------------------------------------


@query(
    "audit_log",
    "audit_log",
    """SELECT * FROM audit_log WHERE event_type = '1-URGENT' AND status = 'SUCCESS'
       ORDER BY event_time DESC, log_id DESC LIMIT 50""",
)
def _(t):
    return op.read_audit_log(t("audit_log"), event_type="1-URGENT", status="SUCCESS")


# Audit rows with details: the customers' segment and balance, broken text for one nation.
DETAILED = """SELECT c_custkey AS log_id, TIMESTAMP '2001-08-02 00:00:00' AS event_time, c_name AS object_name,
                     CASE WHEN c_nationkey = 3 THEN '{broken' ELSE
                     '{"customer":{"segment":"' || c_mktsegment || '","nation":' || CAST(c_nationkey AS VARCHAR(9)) || '}}' END AS details
              FROM customer"""


def _detailed(t):
    customer = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return t.table("customer").select(
        F.col("c_custkey").alias("log_id"),
        F.lit("2001-08-02").cast("timestamp_ntz").alias("event_time"),
        F.col("c_name").alias("object_name"),
        F.when(F.col("c_nationkey") == 3, "{broken")
        .otherwise(op.document(F.to_json(F.struct(customer.alias("customer")))))
        .alias("details"),
    )


@query(
    "audit_by_detail",
    "",
    f"""WITH log AS ({DETAILED}) SELECT l.* FROM log l JOIN customer ON c_custkey = log_id
        WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3""",
)
def _(t):
    # Key order is part of the canonical text, not of the meaning: the SQL's text is compared by value.
    found = op.audit_by_detail(_detailed(t), "$.customer.segment", "BUILDING")
    nation = op.detail("details", "$.customer.nation", "bigint").cast("string")
    text = F.concat(F.lit('{"customer":{"segment":"BUILDING","nation":'), nation, F.lit("}}"))
    return found.withColumn("details", text)


@query(
    "details_per_nation",
    "",
    """SELECT c_nationkey AS nation, count(*) AS actions, count(DISTINCT c_mktsegment) AS segments
       FROM customer WHERE c_nationkey <> 3 GROUP BY 1 UNION ALL
       SELECT NULL, count(*), 0 FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0""",
)
def _(t):
    nation = op.detail("details", "$.customer.nation", "bigint").cast("int").alias("nation")
    segment = op.detail("details", "$.customer.segment")
    return _detailed(t).groupBy(nation).agg(
        F.count(F.lit(1)).alias("actions"), F.countDistinct(segment).alias("segments")
    )


ALERT = "alert_id event_time scope resource_name threshold_pct credits_used credit_limit status message"
ALERTS = f"""SELECT {ALERT.replace(' ', ', ')} FROM (SELECT * RENAME (alert_time AS event_time) FROM monitoring_alert_log)
             WHERE event_time {PERIOD} {top('event_time DESC', ALERT, 200)}"""


@query("alert_history", "monitoring_alert_log", ALERTS)
def _(t):
    return op.alert_history(t("monitoring_alert_log"), START, END)


@query(
    "alert_kpis",
    "monitoring_alert_log",
    f"""SELECT count(*) AS total, count(CASE WHEN status IN ('CRITICAL', 'SUSPENDED', 'EXCEEDED') THEN 1 END) AS critical,
               count(DISTINCT resource_name) AS resources FROM monitoring_alert_log WHERE alert_time {PERIOD}""",
)
def _(t):
    return op.alert_kpis(t("monitoring_alert_log"), START, END)


@query("alert_status_counts", "monitoring_alert_log", f'SELECT status, count(*) AS "count" FROM monitoring_alert_log WHERE alert_time {PERIOD} GROUP BY 1')
def _(t):
    return op.alert_status_counts(t("monitoring_alert_log"), START, END)


@query(
    "serverless_alert_history",
    "monitoring_alert_log",
    f"""SELECT alert_id, alert_time AS event_time, resource_name AS service_type, threshold_pct, credits_used, credit_limit,
               status, message
        FROM monitoring_alert_log WHERE scope = 'SERVERLESS' AND alert_time {PERIOD}
        ORDER BY alert_time DESC, alert_id LIMIT 200""",
)
def _(t):
    return op.serverless_alert_history(t("monitoring_alert_log"), START, END)


EXECUTIONS = f"""SELECT * FROM monitoring_exec_log WHERE execution_time {PERIOD}
                 ORDER BY execution_time DESC, exec_id LIMIT 100"""


@query("execution_history", "monitoring_exec_log", EXECUTIONS)
def _(t):
    return op.execution_history(t("monitoring_exec_log"), START, END)


@query(
    "execution_kpis",
    "monitoring_exec_log",
    f"""SELECT count(*) AS total, count(CASE WHEN status = 'SUCCESS' THEN 1 END) AS succeeded,
               count(CASE WHEN status = 'ERROR' THEN 1 END) AS failed
        FROM monitoring_exec_log WHERE execution_time {PERIOD}""",
)
def _(t):
    return op.execution_kpis(t("monitoring_exec_log"), START, END)


@query(
    "append_log",
    "audit_log",
    """SELECT log_id, event_time, event_type, actor, object_type, object_name, status, details FROM audit_log
       UNION ALL
       SELECT (SELECT max(log_id) FROM audit_log) + row_number() OVER (ORDER BY c_name),
              TIMESTAMP '2001-08-02 00:00:00', 'CREATE', 'loader', 'PROJECT', c_name,
              CASE WHEN c_acctbal < 0 THEN 'ERROR' ELSE 'SUCCESS' END,
              '{"segment":"' || c_mktsegment || '","nation":' || CAST(c_nationkey AS VARCHAR) || '}' FROM customer""",
)
def _(t):
    log = t("audit_log")
    events = t.table("customer").select(
        F.lit("CREATE").alias("event_type"),
        F.lit("PROJECT").alias("object_type"),
        F.col("c_name").alias("object_name"),
        F.when(F.col("c_acctbal") < 0, "ERROR").otherwise("SUCCESS").alias("status"),
        F.to_json(
            F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
        ).alias("details"),
    )
    path = scratch(t.spark, "append_log")
    added = op.append_log(log, events, "log_id", "event_time", NOW, actor="loader", order=("object_name",), path=path)
    return log.unionByName(added)


# ---- upserts ----------------------------------------------------------------------------


def _project_edits(t):
    """New projects, and edits of every stored project of some nations."""
    return t.table("customer").where("c_nationkey < 12").select(
        F.concat(F.lit("P"), F.col("c_custkey")).alias("project_id"),
        F.col("c_name").alias("project_name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("description"),
    )


EDITS = """SELECT 'P' || CAST(c_custkey AS VARCHAR) AS project_id, c_name AS project_name,
                  CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS description FROM customer WHERE c_nationkey < 12"""


@query(
    "upsert",
    "projects",
    f"""
    SELECT coalesce(p.project_id, s.project_id) AS project_id,
           CASE WHEN s.project_id IS NULL THEN p.project_name ELSE s.project_name END AS project_name,
           CASE WHEN s.project_id IS NULL THEN p.description ELSE s.description END AS description,
           p.dsi_db, p.dso_db, CASE WHEN p.project_id IS NULL THEN 'SMALL' ELSE p.wh_size END AS wh_size,
           CASE WHEN p.project_id IS NULL THEN 'ACTIVE' ELSE p.status END AS status,
           CASE WHEN p.project_id IS NULL THEN 99 WHEN s.project_id IS NOT NULL THEN -1 ELSE p.created_at END AS created_at
    FROM projects p FULL JOIN ({EDITS}) s ON p.project_id = s.project_id""",
)
def _(t):
    return op.upsert(
        t("projects"),
        _project_edits(t),
        ["project_id"],
        ["project_name", "description"],
        insert_defaults={"wh_size": "SMALL", "status": "ACTIVE", "created_at": 99},
        touch={"created_at": -1},
    )


@query(
    "insert_if_absent",
    "projects",
    f"""SELECT * FROM projects UNION ALL
        SELECT project_id, project_name, description, NULL, NULL, 'SMALL', 'PENDING', NULL FROM ({EDITS})
        WHERE project_id NOT IN (SELECT project_id FROM projects)""",
)
def _(t):
    return op.insert_if_absent(
        t("projects"), _project_edits(t), ["project_id"], {"wh_size": "SMALL", "status": "PENDING"}
    )


@query(
    "update_where",
    "projects",
    """SELECT * REPLACE (CASE WHEN created_at < 6 THEN 'INACTIVE' ELSE status END AS status,
                         CASE WHEN created_at < 6 THEN NULL ELSE wh_size END AS wh_size) FROM projects""",
)
def _(t):
    return op.update_where(t("projects"), F.col("created_at") < 6, {"status": "INACTIVE", "wh_size": None})


@query(
    "write_project_rule",
    "projects",
    f"""
    SELECT coalesce(p.project_id, s.project_id) AS project_id,
           CASE WHEN s.project_id IS NULL THEN p.project_name ELSE s.project_name END AS project_name,
           CASE WHEN s.project_id IS NULL THEN p.description ELSE s.description END AS description,
           CASE WHEN s.project_id IS NULL THEN p.dsi_db ELSE 'DSI_' || s.project_id END AS dsi_db,
           CASE WHEN s.project_id IS NULL THEN p.dso_db ELSE 'DSO_' || s.project_id END AS dso_db,
           CASE WHEN s.project_id IS NULL THEN p.wh_size ELSE 'MEDIUM' END AS wh_size,
           coalesce(p.status, 'ACTIVE') AS status,
           CASE WHEN p.project_id IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2000-01-01' END AS created_at
    FROM projects p FULL JOIN ({EDITS}) s ON p.project_id = s.project_id""",
)
def _(t):
    stored = t("projects").withColumn("created_at", ntz("2000-01-01"))
    edits = _project_edits(t).select(
        "*",
        F.concat(F.lit("DSI_"), "project_id").alias("dsi_db"),
        F.concat(F.lit("DSO_"), "project_id").alias("dso_db"),
        F.lit("MEDIUM").alias("wh_size"),
    )
    return op.write_control("projects", stored, edits, NOW)


@query(
    "insert_project_roles",
    "projects managed_roles",
    """SELECT role_name, role_type, project_id, created_at FROM managed_roles UNION ALL
       SELECT 'ROLE_' || project_id || '_' || k, k, project_id, NULL FROM projects, (VALUES ('DEVELOPER'), ('ANALYST')) v(k)""",
)
def _(t):
    return op.insert_if_absent(t("managed_roles"), op.project_roles(t("projects")), ["role_name"])


# ---- generated names -----------------------------------------------------------------------


@query(
    "preview_names",
    "naming_convention",
    """SELECT layer_code, 'RETAIL' AS project_id,
              replace(array_to_string(list_filter([prefix, 'RETAIL', suffix], lambda x: x <> ''), chr(1)), chr(1),
                      coalesce(nullif(separator, ''), '_')) AS generated_name, description
       FROM naming_convention WHERE enabled""",
)
def _(t):
    return op.preview_names(t("naming_convention"), "retail")


REQUESTS = """SELECT 'L' || CAST(l_suppkey AS VARCHAR) AS layer_code, 'p' || CAST(l_orderkey AS VARCHAR) AS project_id,
                     't' || CAST(l_partkey AS VARCHAR) AS name FROM lineitem"""


@query(
    "name_objects",
    "naming_convention",
    f"""SELECT r.layer_code, project_id, name, description,
               replace(array_to_string(list_filter([coalesce(nullif(prefix, ''), r.layer_code), upper(project_id), upper(name), suffix],
                   lambda x: x <> ''), chr(1)), chr(1), coalesce(nullif(separator, ''), '_')) AS generated_name
        FROM ({REQUESTS}) r LEFT JOIN (SELECT * FROM naming_convention WHERE enabled) n USING (layer_code)""",
)
def _(t):
    requests = t.table("lineitem").select(
        F.concat(F.lit("L"), F.col("l_suppkey")).alias("layer_code"),
        F.concat(F.lit("p"), F.col("l_orderkey")).alias("project_id"),
        F.concat(F.lit("t"), F.col("l_partkey")).alias("name"),
    )
    return op.name_objects(t("naming_convention"), requests, name="name")
