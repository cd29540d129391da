"""Usage-log shaped views over the TPC-H-style test tables.

Each adapter is one SELECT that reads the same in Spark SQL and in standard SQL,
so the correctness checks can put the same text in front of their own SQL.
``{name}`` stands for a source table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Reference times: last day of the events, orders and line items.
EVENTS_AS_OF = "2024-01-30 23:59:59"
ORDERS_AS_OF = "2001-08-02 00:00:00"
LINES_AS_OF = "2001-11-05 00:00:00"

ADAPTERS: dict[str, str] = {
    # ---- metering -------------------------------------------------------------
    "warehouse_metering_history": """
        SELECT event_type AS warehouse_name, ts AS start_time, ts + INTERVAL '1' HOUR AS end_time,
               value AS credits_used, value * 0.9 AS credits_used_compute,
               value * 0.1 AS credits_used_cloud_services
        FROM {events}""",
    "metering_history": """
        SELECT CASE event_type WHEN 'view' THEN 'WAREHOUSE_METERING' ELSE upper(event_type) END AS service_type,
               ts AS start_time, value AS credits_used
        FROM {events}""",
    "line_metering_history": """
        SELECT CASE l_returnflag WHEN 'A' THEN 'WAREHOUSE_METERING' WHEN 'N' THEN 'PIPE'
               ELSE 'AUTO_CLUSTERING' END AS service_type,
               l_shipdate AS start_time, l_quantity * 0.25 AS credits_used
        FROM {lineitem}""",
    "line_warehouse_metering": """
        SELECT 'WH_' || CAST(l_suppkey AS STRING) AS warehouse_name, l_shipdate AS start_time,
               l_shipdate + INTERVAL '1' HOUR AS end_time, l_quantity * 0.25 AS credits_used,
               l_quantity * 0.1875 AS credits_used_compute, l_quantity * 0.0625 AS credits_used_cloud_services
        FROM {lineitem}""",
    "metering_daily_history": """
        SELECT CAST(ts AS DATE) AS usage_date, sum(value) AS credits_used, sum(value * 0.9) AS credits_used_compute
        FROM {events} GROUP BY CAST(ts AS DATE)""",
    # ---- queries --------------------------------------------------------------
    "query_history": """
        SELECT CAST(event_id AS STRING) AS query_id, props AS query_text, upper(event_type) AS query_type,
               'U' || CAST(user_id AS STRING) AS user_name,
               CASE event_type WHEN 'purchase' THEN 'ANALYST' ELSE 'PUBLIC' END AS role_name,
               event_type AS warehouse_name,
               CASE WHEN event_type IN ('click', 'view') THEN 'SMALL' ELSE 'LARGE' END AS warehouse_size,
               'STANDARD' AS warehouse_type, 'DB_' || upper(event_type) AS database_name,
               'PUBLIC' AS schema_name, CAST(NULL AS STRING) AS query_tag,
               CASE WHEN value < 2 THEN 'RUNNING' WHEN value < 4 THEN 'QUEUED'
                    WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status,
               CASE WHEN event_type = 'error' THEN 'E1' END AS error_code,
               CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error_message,
               ts AS start_time, ts + INTERVAL '1' MINUTE AS end_time,
               CAST(round(value * 1000) AS BIGINT) AS total_elapsed_time,
               CAST(round(value * 900) AS BIGINT) AS execution_time,
               CAST(round(value * 50) AS BIGINT) AS compilation_time,
               CAST(round(value * 30) AS BIGINT) AS queued_provisioning_time,
               CAST(round(value * 20) AS BIGINT) AS queued_overload_time,
               event_id * 100000 AS bytes_scanned, user_id * 1000 AS bytes_written,
               CASE WHEN value >= 100 THEN event_id * 50000 ELSE 0 END AS bytes_spilled_to_local_storage,
               CASE WHEN value >= 250 THEN event_id * 20000 ELSE 0 END AS bytes_spilled_to_remote_storage,
               user_id * 10 AS rows_produced, user_id * 3 AS rows_inserted, user_id * 2 AS rows_updated,
               user_id AS rows_deleted, user_id AS partitions_scanned, user_id + 10 AS partitions_total,
               value / 500 AS percentage_scanned_from_cache, value / 100 AS credits_used_cloud_services
        FROM {events}""",
    "line_query_history": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS query_id,
               l_returnflag || l_linestatus AS query_text, 'SELECT' AS query_type,
               'S' || CAST(l_suppkey AS STRING) AS user_name, l_returnflag AS warehouse_name,
               CASE l_linestatus WHEN 'F' THEN 'SUCCESS' ELSE 'FAIL' END AS execution_status,
               CASE l_linestatus WHEN 'F' THEN CAST(NULL AS STRING) ELSE 'E2' END AS error_code,
               CASE l_linestatus WHEN 'F' THEN CAST(NULL AS STRING) ELSE 'open line' END AS error_message,
               l_shipdate AS start_time, CAST(round(l_extendedprice) AS BIGINT) AS total_elapsed_time,
               l_partkey * 1000000 AS bytes_scanned,
               CASE WHEN l_discount >= 0.05 THEN l_partkey * 100000 ELSE 0 END AS bytes_spilled_to_local_storage,
               CASE WHEN l_discount >= 0.1 THEN l_partkey * 10000 ELSE 0 END AS bytes_spilled_to_remote_storage,
               l_quantity * 0.25 AS credits_used_cloud_services
        FROM {lineitem}""",
    "query_attribution_history": """
        SELECT CAST(event_id AS STRING) AS query_id, event_type AS warehouse_name, ts AS start_time,
               value * 0.05 AS credits_attributed_compute, value * 0.01 AS credits_used_query_acceleration
        FROM {events}""",
    "warehouse_load_history": """
        SELECT event_type AS warehouse_name, ts AS start_time, value / 100 AS avg_running,
               greatest(value - 100, 0) / 100 AS avg_queued_load, 0.0 * value AS avg_blocked
        FROM {events}""",
    "line_warehouse_load": """
        SELECT 'WH_' || CAST(l_suppkey AS STRING) AS warehouse_name, l_shipdate AS start_time,
               l_tax AS avg_running,
               CASE WHEN l_quantity > 49 THEN l_discount * 20 WHEN l_quantity > 30 THEN l_discount * 4
                    ELSE 0 * l_discount END AS avg_queued_load,
               l_discount / 10 AS avg_blocked
        FROM {lineitem}""",
    # ---- logins, sessions, users, grants ----------------------------------------
    "login_history": """
        SELECT event_id, ts AS event_timestamp, 'U' || CAST(user_id AS STRING) AS user_name,
               '10.0.0.' || regexp_extract(props, '[0-9]+', 0) AS client_ip,
               event_type AS reported_client_type, '1.0' AS reported_client_version,
               'PASSWORD' AS first_authentication_factor,
               CASE WHEN value >= 40 THEN 'MFA' END AS second_authentication_factor,
               CASE WHEN event_type = 'error' THEN 'NO' ELSE 'YES' END AS is_success,
               CASE WHEN event_type = 'error' THEN '390100' END AS error_code,
               CASE WHEN event_type = 'error' THEN 'INCORRECT_USERNAME_PASSWORD' END AS error_message,
               CAST(NULL AS STRING) AS connection
        FROM {events}""",
    "sessions": """
        SELECT conv_id AS session_id, role AS user_name, turn,
               CASE role WHEN 'user' THEN 'PASSWORD' ELSE 'KEYPAIR' END AS authentication_method,
               CASE WHEN turn < 2 THEN 'WEB' ELSE 'CLI' END AS client_application_id,
               CASE WHEN turn = 0 THEN CAST(NULL AS STRING) ELSE 'EXPIRED' END AS closed_reason
        FROM {conversations}""",
    "users": """
        SELECT 'U' || CAST(c.c_custkey AS STRING) AS name, lower(c.c_name) || '@example.com' AS email,
               'ROLE_' || c.c_mktsegment AS default_role,
               c.c_acctbal >= 1000 AS has_password, c.c_nationkey < 10 AS has_rsa_public_key,
               c.c_mktsegment IN ('BUILDING', 'MACHINERY') AS ext_authn_duo,
               CASE WHEN c.c_nationkey = 7 THEN CAST(NULL AS BOOLEAN)
                    ELSE c.c_mktsegment IN ('BUILDING', 'MACHINERY') END AS has_mfa,
               c.c_acctbal < 0 AS disabled,
               CASE WHEN c.c_nationkey <> 11 THEN o.last_order END AS last_success_login,
               CASE WHEN c.c_acctbal > 9500 THEN o.last_order END AS deleted_on
        FROM {customer} c
        LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM {orders} GROUP BY o_custkey) o
          ON o.o_custkey = c.c_custkey""",
    "grants_to_users": """
        SELECT 'U' || CAST(o_custkey AS STRING) AS grantee_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'ACCOUNTADMIN' WHEN '2-HIGH' THEN 'SYSADMIN'
                    WHEN '3-MEDIUM' THEN 'SECURITYADMIN' ELSE 'PUBLIC' END AS role,
               min(o_orderdate) AS created_on, min(o_orderstatus) AS granted_by,
               CASE WHEN max(o_totalprice) > 450000 THEN max(o_orderdate) END AS deleted_on
        FROM {orders} GROUP BY o_custkey, o_orderpriority""",
    "grants_to_roles": """
        SELECT o_orderdate AS created_on,
               CASE o_orderstatus WHEN 'F' THEN 'SELECT' WHEN 'O' THEN 'INSERT' ELSE 'USAGE' END AS privilege,
               'TABLE' AS granted_on, 'T' || CAST(o_orderkey AS STRING) AS name,
               'ROLE_' || CAST(o_custkey AS STRING) AS grantee_name, o_orderpriority AS granted_by,
               CASE WHEN o_totalprice > 400000 THEN o_orderdate END AS deleted_on
        FROM {orders}""",
    "roles": """
        SELECT 'ROLE_' || CAST(c_custkey AS STRING) AS name, o.first_order AS created_on,
               c_mktsegment AS comment, CASE WHEN c_acctbal < 0 THEN o.first_order END AS deleted_on
        FROM {customer}
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey) o
          ON o.o_custkey = c_custkey""",
    # ---- policies -----------------------------------------------------------------
    "network_policies": """
        SELECT s_name AS name, 'OWNER_' || CAST(s_nationkey AS STRING) AS owner, 'nation ' || CAST(s_nationkey AS STRING) AS comment,
               CASE WHEN s_nationkey < 15 THEN '10.0.0.0/8' END AS allowed_ip_list,
               CASE WHEN s_nationkey > 5 THEN '192.168.0.0/16' END AS blocked_ip_list,
               CASE WHEN s_acctbal < 1000 THEN 'deleted' END AS deleted
        FROM {supplier}""",
    "password_policies": """
        SELECT c_name AS name, 4 + c_nationkey AS password_min_length,
               CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS password_min_upper_case_chars, 1 AS password_min_lower_case_chars,
               1 AS password_min_numeric_chars,
               CASE WHEN c_acctbal > 4000 THEN 2 ELSE 0 END AS password_min_special_chars,
               CASE WHEN c_acctbal > 9000 THEN 'deleted' END AS deleted
        FROM {customer}""",
    "session_policies": """
        SELECT s_name AS name, 15 * (s_nationkey + 1) AS session_idle_timeout_mins,
               CASE WHEN s_acctbal < 0 THEN 'deleted' END AS deleted
        FROM {supplier}""",
    "masking_policies": """
        SELECT 'MASK_' || CAST(p_partkey AS STRING) AS policy_name, p_size AS created, p_brand AS policy_owner,
               CASE WHEN p_type = 'ECONOMY' THEN 'deleted' END AS deleted
        FROM {part}""",
    "row_access_policies": """
        SELECT 'RAP_' || s_name AS policy_name, s_nationkey AS created, 'SECADMIN' AS policy_owner,
               CASE WHEN s_acctbal < 5000 THEN 'deleted' END AS deleted
        FROM {supplier}""",
    "shares": """
        SELECT s_name AS name, 'OWNER_' || CAST(s_nationkey AS STRING) AS owner,
               CASE WHEN s_acctbal < 0 THEN CAST(NULL AS STRING) ELSE 'shared' END AS comment
        FROM {supplier}""",
    "resource_monitors": """
        SELECT s_name AS name, CAST(CASE WHEN s_nationkey = 3 THEN 0 ELSE 8000 END AS DOUBLE) AS credit_quota,
               abs(s_acctbal) AS used_credits, 8000.0 - abs(s_acctbal) AS remaining_credits,
               'OWNER_' || CAST(s_nationkey AS STRING) AS owner
        FROM {supplier}""",
    "warehouse_settings": """
        SELECT 'WH_' || CAST(s_suppkey AS STRING) AS name,
               CASE WHEN s_acctbal < 3000 THEN 'SMALL' ELSE 'LARGE' END AS size, 'STANDARD' AS type,
               CASE WHEN s_acctbal < 0 THEN 'SUSPENDED' ELSE 'STARTED' END AS state,
               CASE WHEN s_nationkey < 3 THEN CAST(NULL AS STRING) WHEN s_nationkey = 24 THEN 'abc'
                    WHEN s_nationkey < 8 THEN '60' WHEN s_nationkey < 14 THEN '300' WHEN s_nationkey < 18 THEN '600'
                    ELSE CAST(s_nationkey * 40 AS STRING) END AS auto_suspend,
               'true' AS auto_resume,
               CASE WHEN s_nationkey < 10 THEN '1' WHEN s_nationkey < 20 THEN '2' END AS min_cluster_count,
               CASE WHEN s_nationkey < 5 THEN '1' WHEN s_nationkey < 20 THEN '4' END AS max_cluster_count,
               'ECONOMY' AS scaling_policy, 'OWNER_' || CAST(s_nationkey AS STRING) AS owner
        FROM {supplier}""",
    # ---- storage, loads, tasks ------------------------------------------------------
    "storage_usage": """
        SELECT CAST(l_shipdate AS DATE) AS usage_date, round(sum(l_extendedprice)) * 1000000 AS storage_bytes,
               sum(l_quantity) * 1000000 AS stage_bytes, round(sum(l_tax) * 100) * 10000000 AS failsafe_bytes
        FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)""",
    "database_storage_usage_history": """
        SELECT 'DB_' || l_returnflag AS database_name, CAST(l_shipdate AS DATE) AS usage_date,
               sum(l_quantity) * 1000000 AS average_database_bytes
        FROM {lineitem} GROUP BY l_returnflag, CAST(l_shipdate AS DATE)""",
    "stage_storage_usage_history": """
        SELECT CAST(o_orderdate AS DATE) AS usage_date, round(sum(o_totalprice)) * 1000 AS average_stage_bytes
        FROM {orders} GROUP BY CAST(o_orderdate AS DATE)""",
    "copy_history": """
        SELECT 'PIPE_' || o_orderstatus AS pipe_name, 'file-' || CAST(o_orderkey AS STRING) AS file_name,
               'stage/' || o_orderpriority AS stage_location, o_orderdate AS last_load_time,
               CAST(round(o_totalprice) AS BIGINT) AS row_count, CAST(round(o_totalprice) AS BIGINT) + 3 AS row_parsed,
               CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 0 END AS error_count,
               CASE WHEN o_orderstatus = 'P' THEN 'PARTIAL' ELSE 'LOADED' END AS status
        FROM {orders}""",
    "tables": """
        SELECT 'DB_' || p_brand AS table_catalog, p_type AS table_schema, 'T' || CAST(p_partkey AS STRING) AS table_name,
               CASE WHEN p_size = 13 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type, p_partkey * 10 AS row_count,
               CASE WHEN p_size = 14 THEN 0 ELSE CAST(round(p_retailprice * 1000000) AS BIGINT) END AS bytes,
               p_size AS created, p_size AS last_altered,
               CASE WHEN p_size = 15 THEN 'deleted' END AS deleted
        FROM {part}""",
    "stages": """
        SELECT 'DB_' || p_brand AS stage_catalog, p_type AS stage_schema, 'STAGE_' || CAST(p_partkey AS STRING) AS stage_name,
               CASE WHEN p_size < 20 THEN 'Internal Named' ELSE 'EXTERNAL NAMED' END AS stage_type,
               CASE WHEN p_size < 20 THEN CAST(NULL AS STRING) ELSE 's3://' || p_brand END AS stage_url,
               p_size AS created, p_size AS last_altered, p_name AS stage_owner,
               CASE WHEN p_size = 15 THEN 'deleted' END AS deleted
        FROM {part}""",
    "task_history": """
        SELECT o_orderkey AS run_id, 'TASK_' || CAST(o_custkey AS STRING) AS name, o_orderpriority AS database_name,
               'PUBLIC' AS schema_name,
               CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCEEDED' ELSE 'SCHEDULED' END AS state,
               o_orderdate AS scheduled_time, o_orderdate + INTERVAL '1' MINUTE AS completed_time,
               CAST(NULL AS STRING) AS return_value,
               CASE o_orderstatus WHEN 'F' THEN 'E3' END AS error_code,
               CASE o_orderstatus WHEN 'F' THEN 'task failed' END AS error_message
        FROM {orders}""",
    "serverless_task_history": """
        SELECT 'TASK_' || CAST(o_custkey AS STRING) AS task_name, o_orderdate AS start_time,
               round(o_totalprice) * 0.25 AS credits_used FROM {orders}""",
    "pipe_usage_history": """
        SELECT 'PIPE_' || o_orderstatus AS pipe_name, o_orderdate AS start_time, round(o_totalprice) * 0.125 AS credits_used,
               o_custkey AS files_inserted, CAST(round(o_totalprice) AS BIGINT) * 1000 AS bytes_inserted
        FROM {orders}""",
    "automatic_clustering_history": """
        SELECT 'T' || CAST(l_partkey AS STRING) AS table_name, l_shipdate AS start_time, l_quantity * 0.5 AS credits_used,
               l_partkey * 1000 AS num_bytes_reclustered
        FROM {lineitem}""",
    "materialized_view_refresh_history": """
        SELECT 'MV_' || CAST(p_partkey AS STRING) AS table_name,
               CASE WHEN p_size < 40 THEN CAST(p_size AS DOUBLE) * 0.25 END AS credits_used FROM {part}""",
    "replication_usage_history": """
        SELECT s_name AS database_name, CAST(s_nationkey AS DOUBLE) * 0.5 AS credits_used, s_suppkey * 1000000 AS bytes_transferred
        FROM {supplier}""",
    "data_transfer_history": """
        SELECT c_mktsegment AS target_region, c_custkey * 1000 AS bytes_transferred FROM {customer}""",
    # ---- control tables ---------------------------------------------------------------
    "warehouse_config": """
        SELECT s_name AS monitor_owner, 'WH_' || CAST(s_suppkey AS STRING) AS warehouse_name,
               CASE WHEN s_nationkey < 5 THEN 'WEEKLY' WHEN s_nationkey < 10 THEN 'MONTHLY' WHEN s_nationkey < 13 THEN 'YEARLY'
                    WHEN s_nationkey < 15 THEN 'NEVER' ELSE 'DAILY' END AS frequency,
               CASE WHEN s_nationkey = 20 THEN 0.0 ELSE round(abs(s_acctbal) / 500) + 4 END AS credit_limit,
               s_acctbal > 5000 AS auto_suspend_at_100, true AS alert_threshold_70, s_nationkey < 20 AS alert_threshold_85,
               s_acctbal > 0 AS alert_threshold_95,
               CASE WHEN s_acctbal >= 0 THEN split('ops@example.com,' || lower(s_name) || '@example.com', ',') END AS alert_emails,
               s_acctbal < 9500 AS is_active
        FROM {supplier}""",
    "event_quota_config": """
        SELECT warehouse_name, 'DAILY' AS frequency, credit_limit, is_suspend AS auto_suspend_at_100,
               CASE WHEN is_suspend THEN split('ops@example.com,fin@example.com', ',') END AS alert_emails, is_active
        FROM (SELECT event_type AS warehouse_name, event_type IN ('click', 'error') AS is_suspend, true AS is_active,
                     CAST(CASE event_type WHEN 'click' THEN 3500 WHEN 'error' THEN 2800 WHEN 'purchase' THEN 3000
                               WHEN 'signup' THEN 3800 ELSE 10000 END AS DOUBLE) AS credit_limit
              FROM {events} GROUP BY event_type
              UNION ALL
              SELECT 'idle_' || r_name, false, r_regionkey < 4,
                     CAST(CASE WHEN r_regionkey = 0 THEN 0 ELSE 100 END AS DOUBLE)
              FROM {region}) c""",
    "serverless_config": """
        SELECT service_type, 'DAILY' AS frequency, credit_limit, split('ops@example.com', ',') AS alert_emails, is_active
        FROM (SELECT upper(event_type) AS service_type, event_type <> 'view' AS is_active,
                     CAST(CASE event_type WHEN 'click' THEN 3500 WHEN 'error' THEN 2800 WHEN 'purchase' THEN 3000
                               ELSE 3800 END AS DOUBLE) AS credit_limit
              FROM {events} GROUP BY event_type) c""",
    "naming_convention": """
        SELECT 'L' || CAST(s_suppkey AS STRING) AS layer_code,
               CASE WHEN s_nationkey < 18 THEN 'DSI' WHEN s_nationkey < 22 THEN '' END AS prefix,
               CASE WHEN s_nationkey < 9 THEN 'X' WHEN s_nationkey < 12 THEN '' END AS suffix,
               CASE WHEN s_nationkey < 3 THEN '-' WHEN s_nationkey < 20 THEN '_' WHEN s_nationkey < 22 THEN '' END AS separator,
               s_name AS description, s_acctbal > 0 AS enabled
        FROM {supplier}""",
    "projects": """
        SELECT 'P' || CAST(s_suppkey AS STRING) AS project_id, s_name AS project_name, 'nation ' || CAST(s_nationkey AS STRING) AS description,
               'DSI_P' || CAST(s_suppkey AS STRING) AS dsi_db, 'DSO_P' || CAST(s_suppkey AS STRING) AS dso_db,
               CASE WHEN s_acctbal < 3000 THEN 'SMALL' ELSE 'LARGE' END AS wh_size,
               CASE WHEN s_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, s_nationkey AS created_at
        FROM {supplier}""",
    "managed_objects": """
        SELECT 'P' || CAST(l_suppkey AS STRING) || '.T' || CAST(l_partkey AS STRING) AS object_id,
               min(l_returnflag) AS object_type, 'T' || CAST(l_partkey AS STRING) AS object_name,
               CASE WHEN min(l_linestatus) = 'F' THEN 'DSI' ELSE 'DSO' END AS layer,
               'P' || CAST(l_suppkey AS STRING) AS project_id, min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at
        FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "managed_roles": """
        SELECT 'ROLE_P' || CAST(s_suppkey AS STRING) || '_ADMIN' AS role_name, 'ADMIN' AS role_type,
               'P' || CAST(s_suppkey AS STRING) AS project_id, s_nationkey AS created_at
        FROM {supplier}""",
    "connectors": """
        SELECT 'P' || CAST(c_nationkey AS STRING) || '_' || CAST(c_custkey AS STRING) AS connector_key, c_name AS connector_name,
               c_mktsegment AS service, 'schema_' || lower(c_mktsegment) AS destination_schema,
               'DSI_P' || CAST(c_nationkey AS STRING) AS dsi_db, 'P' || CAST(c_nationkey AS STRING) AS project_id,
               CASE WHEN c_acctbal > 2000 THEN 'ext-' || CAST(c_custkey AS STRING) WHEN c_acctbal > 1000 THEN '' END AS external_connector_id,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ACTIVE' ELSE 'PENDING' END AS status,
               c_custkey AS created_at
        FROM {customer}""",
    "external_connections": """
        SELECT s_name AS connection_name, 'GIT' AS connection_type,
               CASE WHEN s_nationkey < 8 THEN 'CONNECTED' WHEN s_nationkey < 14 THEN 'ERROR'
                    WHEN s_nationkey < 20 THEN 'PENDING' WHEN s_nationkey < 22 THEN 'OTHER' END AS status
        FROM {supplier}""",
    "account_config": """
        SELECT 'KEY_' || CAST(s_suppkey AS STRING) AS config_key, '"' || s_name || '"' AS config_value,
               'nation ' || CAST(s_nationkey AS STRING) AS description, s_nationkey AS updated_at
        FROM {supplier}""",
    "audit_log": """
        SELECT o_orderkey AS log_id, o_orderdate AS event_time, o_orderpriority AS event_type,
               'U' || CAST(o_custkey AS STRING) AS actor, 'TABLE' AS object_type,
               'T' || CAST(o_orderkey AS STRING) AS object_name,
               CASE o_orderstatus WHEN 'F' THEN 'ERROR' ELSE 'SUCCESS' END AS status,
               '{}' AS details
        FROM {orders}""",
    "monitoring_exec_log": """
        SELECT o_orderkey AS exec_id, o_orderdate AS execution_time, 'WAREHOUSE' AS scope,
               CASE o_orderstatus WHEN 'F' THEN 'ERROR' ELSE 'SUCCESS' END AS status, '{}' AS details
        FROM {orders}""",
    "monitoring_alert_log": """
        SELECT o_orderkey AS alert_id, o_orderdate AS alert_time,
               CASE o_orderstatus WHEN 'P' THEN 'SERVERLESS' ELSE 'WAREHOUSE' END AS scope,
               'WH_' || CAST(o_custkey AS STRING) AS resource_name,
               CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 95 WHEN '3-MEDIUM' THEN 85
                         ELSE 70 END AS DOUBLE) AS threshold_pct,
               round(o_totalprice) AS credits_used, CAST(500000 AS DOUBLE) AS credit_limit,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'SUSPENDED' WHEN '2-HIGH' THEN 'CRITICAL'
                    WHEN '3-MEDIUM' THEN 'ACTION_REQUIRED' ELSE 'MONITORING' END AS status,
               'quota reached' AS message
        FROM {orders}""",
}

_PLACEHOLDER = re.compile(r"\{([a-z]+)\}")


def source_tables(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(ADAPTERS[name])))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Written as a pattern because a stream takes a plain path to be a folder; this matches
    # a single file as well.
    schema = read_table(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def log_frame(spark: SparkSession, name: str, table_of: Callable[[str], DataFrame]) -> DataFrame:
    """The adapter ``name`` over source tables, batch or streaming, given by ``table_of``."""
    tables = {t: table_of(t) for t in source_tables(name)}
    # '{}' as a JSON literal would be taken for a placeholder by the formatter.
    return spark.sql(ADAPTERS[name].replace("'{}'", "'{{}}'"), **tables)


def log_sql(name: str) -> str:
    """The adapter as plain SQL over the source tables."""
    return _PLACEHOLDER.sub(r"\1", ADAPTERS[name])


def with_logs(sql: str, *names: str) -> str:
    """``sql`` with the named adapters as common table expressions in front."""
    ctes = ",\n".join(f"{name} AS ({log_sql(name)})" for name in names)
    head = sql.lstrip()
    if head[:5].lower() == "with ":
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{head}"
