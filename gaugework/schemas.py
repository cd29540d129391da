"""Schemas: control tables with their keys, and the usage logs by column."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "ts": T.TimestampNTZType(),
    "credits": T.DecimalType(18, 4),
    "pct": T.DecimalType(5, 1),
    "json": T.StringType(),
    "strings": T.ArrayType(T.StringType()),
}


def _struct(text: str) -> T.StructType:
    fields = [part.split(":") for part in text.split()]
    return T.StructType([T.StructField(name, _SIMPLE[kind]) for name, kind in fields])


# JSON documents are kept as text; parse_json turns them into VARIANT where needed.
CONTROL_SCHEMAS: dict[str, T.StructType] = {
    "account_config": _struct("config_key:string config_value:json description:string updated_at:ts updated_by:string"),
    "naming_convention": _struct(
        "layer_code:string prefix:string suffix:string separator:string description:string enabled:bool updated_at:ts"
    ),
    "external_connections": _struct(
        "connection_name:string connection_type:string endpoint_url:string account_id:string secret_ref:string "
        "status:string last_test_at:ts last_test_msg:string created_at:ts updated_at:ts"
    ),
    "projects": _struct(
        "project_id:string project_name:string description:string dsi_db:string dso_db:string wh_size:string "
        "status:string created_at:ts created_by:string"
    ),
    "managed_roles": _struct(
        "role_name:string role_type:string project_id:string privileges:json created_at:ts"
    ),
    "managed_objects": _struct(
        "object_id:string object_type:string object_name:string layer:string project_id:string "
        "managed:bool metadata:json created_at:ts updated_at:ts"
    ),
    "connectors": _struct(
        "connector_key:string connector_name:string service:string destination_schema:string dsi_db:string "
        "group_id:string sync_frequency:long paused:bool project_id:string external_connector_id:string "
        "status:string created_at:ts updated_at:ts"
    ),
    "transform_projects": _struct(
        "transform_key:string project_name:string repo_url:string project_subdir:string account:string "
        "database_name:string schema_name:string warehouse_name:string project_id:string external_id:string "
        "status:string created_at:ts updated_at:ts"
    ),
    "audit_log": _struct(
        "log_id:long event_time:ts event_type:string actor:string object_type:string object_name:string "
        "status:string details:json"
    ),
    "warehouse_config": _struct(
        "warehouse_name:string frequency:string credit_limit:credits auto_suspend_at_100:bool "
        "alert_threshold_70:bool alert_threshold_85:bool alert_threshold_95:bool alert_emails:strings "
        "is_active:bool created_at:ts updated_at:ts"
    ),
    "serverless_config": _struct(
        "service_type:string frequency:string credit_limit:credits alert_emails:strings is_active:bool created_at:ts"
    ),
    "monitoring_alert_log": _struct(
        "alert_id:long alert_time:ts scope:string resource_name:string threshold_pct:pct credits_used:credits "
        "credit_limit:credits status:string message:string"
    ),
    "monitoring_exec_log": _struct(
        "exec_id:long execution_time:ts scope:string status:string details:json"
    ),
}

CONTROL_KEYS: dict[str, tuple[str, ...]] = {
    "account_config": ("config_key",),
    "naming_convention": ("layer_code",),
    "external_connections": ("connection_name",),
    "projects": ("project_id",),
    "managed_roles": ("role_name",),
    "managed_objects": ("object_id",),
    "connectors": ("connector_key",),
    "transform_projects": ("transform_key",),
    "audit_log": ("log_id",),
    "warehouse_config": ("warehouse_name",),
    "serverless_config": ("service_type",),
    "monitoring_alert_log": ("alert_id",),
    "monitoring_exec_log": ("exec_id",),
}

# Values that a new row takes where the writer gives none.
CONTROL_DEFAULTS: dict[str, dict[str, object]] = {
    "naming_convention": {"separator": "_", "enabled": True},
    "external_connections": {"status": "PENDING"},
    "projects": {"wh_size": "SMALL", "status": "ACTIVE"},
    "managed_objects": {"managed": True},
    "connectors": {"paused": False, "status": "PENDING"},
    "transform_projects": {"status": "PENDING"},
    "warehouse_config": {
        "frequency": "DAILY",
        "credit_limit": 100,
        "auto_suspend_at_100": False,
        "alert_threshold_70": True,
        "alert_threshold_85": True,
        "alert_threshold_95": True,
        "is_active": True,
    },
    "serverless_config": {"frequency": "DAILY", "credit_limit": 50, "is_active": True},
}

# Types offered for the business columns of a landing table.
LANDING_TYPES: dict[str, T.DataType] = {
    "VARCHAR(500)": T.StringType(),
    "NUMBER(18,0)": T.DecimalType(18, 0),
    "NUMBER(18,4)": T.DecimalType(18, 4),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "BOOLEAN": T.BooleanType(),
    "VARIANT": T.VariantType(),
}


def landing_schema(columns: dict[str, str]) -> T.StructType:
    """Schema of a landing table from name -> type pairs."""
    if not columns:
        raise ValueError("a landing table has at least one business column")
    return T.StructType([T.StructField(name, LANDING_TYPES[kind]) for name, kind in columns.items()])


# Columns the operators read from each usage log.
USAGE_LOGS: dict[str, T.StructType] = {
    "query_history": _struct(
        "query_id:string query_text:string query_type:string user_name:string role_name:string "
        "warehouse_name:string warehouse_size:string warehouse_type:string database_name:string "
        "schema_name:string query_tag:string execution_status:string error_code:string error_message:string "
        "start_time:ts end_time:ts total_elapsed_time:long execution_time:long compilation_time:long "
        "queued_provisioning_time:long queued_overload_time:long bytes_scanned:long bytes_written:long "
        "bytes_spilled_to_local_storage:long bytes_spilled_to_remote_storage:long rows_produced:long "
        "rows_inserted:long rows_updated:long rows_deleted:long partitions_scanned:long partitions_total:long "
        "percentage_scanned_from_cache:double credits_used_cloud_services:double"
    ),
    "query_attribution_history": _struct(
        "query_id:string credits_attributed_compute:double credits_used_query_acceleration:double"
    ),
    "warehouse_metering_history": _struct(
        "warehouse_name:string start_time:ts end_time:ts credits_used:double credits_used_compute:double "
        "credits_used_cloud_services:double"
    ),
    "metering_history": _struct("service_type:string start_time:ts credits_used:double"),
    "metering_daily_history": _struct("usage_date:date credits_used:double credits_used_compute:double"),
    "storage_usage": _struct("usage_date:date storage_bytes:double stage_bytes:double failsafe_bytes:double"),
    "database_storage_usage_history": _struct("usage_date:date average_database_bytes:double"),
    "stage_storage_usage_history": _struct("usage_date:date average_stage_bytes:double"),
    "login_history": _struct(
        "event_id:long event_timestamp:ts user_name:string client_ip:string reported_client_type:string "
        "reported_client_version:string first_authentication_factor:string second_authentication_factor:string "
        "is_success:string error_code:string error_message:string connection:string"
    ),
    "sessions": _struct(
        "session_id:long user_name:string created_on:ts authentication_method:string "
        "client_application_id:string closed_reason:string"
    ),
    "users": _struct(
        "name:string email:string default_role:string has_password:bool has_rsa_public_key:bool ext_authn_duo:bool "
        "has_mfa:bool disabled:bool last_success_login:ts deleted_on:ts"
    ),
    "roles": _struct("name:string created_on:ts comment:string deleted_on:ts"),
    "grants_to_users": _struct("grantee_name:string role:string created_on:ts granted_by:string deleted_on:ts"),
    "grants_to_roles": _struct(
        "created_on:ts privilege:string granted_on:string name:string grantee_name:string granted_by:string deleted_on:ts"
    ),
    "network_policies": _struct(
        "name:string owner:string comment:string allowed_ip_list:string blocked_ip_list:string deleted:ts"
    ),
    "password_policies": _struct(
        "name:string password_min_length:long password_min_upper_case_chars:long password_min_lower_case_chars:long "
        "password_min_numeric_chars:long password_min_special_chars:long deleted:ts"
    ),
    "session_policies": _struct("name:string session_idle_timeout_mins:long deleted:ts"),
    "masking_policies": _struct("policy_name:string created:ts policy_owner:string deleted:ts"),
    "row_access_policies": _struct("policy_name:string created:ts policy_owner:string deleted:ts"),
    "shares": _struct("name:string owner:string comment:string"),
    "resource_monitors": _struct(
        "name:string credit_quota:double used_credits:double remaining_credits:double owner:string"
    ),
    "warehouse_load_history": _struct(
        "warehouse_name:string start_time:ts avg_running:double avg_queued_load:double avg_blocked:double"
    ),
    "copy_history": _struct(
        "pipe_name:string file_name:string stage_location:string last_load_time:ts row_count:long row_parsed:long "
        "error_count:long status:string"
    ),
    "tables": _struct(
        "table_catalog:string table_schema:string table_name:string table_type:string row_count:long bytes:long "
        "created:ts last_altered:ts deleted:ts"
    ),
    "stages": _struct(
        "stage_catalog:string stage_schema:string stage_name:string stage_type:string stage_url:string "
        "stage_owner:string created:ts last_altered:ts deleted:ts"
    ),
    "task_history": _struct(
        "run_id:long name:string database_name:string schema_name:string state:string scheduled_time:ts "
        "completed_time:ts return_value:string error_code:string error_message:string"
    ),
    "serverless_task_history": _struct("start_time:ts credits_used:double"),
    "pipe_usage_history": _struct("start_time:ts credits_used:double files_inserted:long bytes_inserted:long"),
    "automatic_clustering_history": _struct("start_time:ts credits_used:double num_bytes_reclustered:long"),
    "materialized_view_refresh_history": _struct("start_time:ts credits_used:double"),
    "replication_usage_history": _struct("start_time:ts credits_used:double bytes_transferred:long"),
    "data_transfer_history": _struct("start_time:ts bytes_transferred:long"),
}
