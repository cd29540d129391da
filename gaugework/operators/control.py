"""Writes to control tables and logs, as functions from frame to frame.

``upsert`` and friends return the new state; ``VersionedTable`` (sources.tables)
stores it.  Spark does not enforce keys, so ``upsert`` does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions import asc, desc, ntz, numbered, ordered, top_k
from gaugework.operators.filters import optional_filters, period_filter
from gaugework.operators.reshape import union_all
from gaugework.operators.users import EDITABLE
from gaugework.schemas import CONTROL_DEFAULTS, CONTROL_KEYS
from gaugework.session import work_dir


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``; running the plan fails when a key occurs twice.

    Meant for rows of control tables: all rows of a key meet in one task.
    """
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    fails = F.raise_error(F.concat(F.lit("duplicate source key: "), named)).cast("boolean")
    return df.withColumn("_times", times).where(F.when(F.col("_times") > 1, fails).otherwise(True)).drop("_times")


def _with_defaults(rows: DataFrame, target: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    columns = []
    for f in target.schema.fields:
        value = F.col(f.name) if f.name in rows.columns else _as_column(defaults.get(f.name))
        columns.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    insert_defaults: Mapping[str, object] | None = None,
    touch: Mapping[str, object] | None = None,
) -> DataFrame:
    """Matched rows take ``update_cols`` from the source and the ``touch`` values (such as
    ``updated_at``); new keys are inserted, missing columns from ``insert_defaults``.

    A NULL in the source overwrites: presence is decided by a flag per side, never by
    looking at values.  Columns that are not listed survive.  Duplicate source keys
    fail when the plan runs.
    """
    source = unique(source, keys)
    defaults, touched = dict(insert_defaults or {}), dict(touch or {})
    t = target.withColumn("_stored", F.lit(True)).alias("t")
    s = source.withColumn("_given", F.lit(True)).alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    matched = F.col("_stored").isNotNull() & F.col("_given").isNotNull()
    inserted = F.col("_stored").isNull()
    columns = []
    for f in target.schema.fields:
        name = f.name
        old = F.col(f"t.{name}")
        given = F.col(f"s.{name}") if name in source.columns else _as_column(defaults.get(name))
        new = given.cast(f.dataType)
        if name in keys:
            value = F.coalesce(old, new)
        else:
            value = F.when(inserted, new)
            if name in touched:
                value = value.when(matched, _as_column(touched[name]).cast(f.dataType))
            elif name in update_cols:
                value = value.when(matched, F.col(f"s.{name}").cast(f.dataType))
            value = value.otherwise(old)
        columns.append(value.alias(name))
    return both.select(*columns)


def insert_if_absent(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    insert_defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Target plus the source rows whose key it lacks; stored rows stay as they are."""
    fresh = unique(source, keys).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(_with_defaults(fresh, target, insert_defaults or {}))


def update_where(df: DataFrame, cond: Column, assignments: Mapping[str, object]) -> DataFrame:
    hit = F.coalesce(cond, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            name: F.when(hit, _as_column(value).cast(kinds[name])).otherwise(F.col(name))
            for name, value in assignments.items()
        }
    )


def append_log(
    log: DataFrame,
    events: DataFrame,
    id_col: str,
    time_col: str,
    as_of,
    actor: str | None = None,
    order: tuple[Column | str, ...] = (),
    path: str | None = None,
) -> DataFrame:
    """New log rows for ``events``, ready to be appended.

    Ids continue after the highest stored one without gaps, in ``order`` if given.  The batch is written to ``path`` (by
    default a fresh work folder) while it is numbered, so its rows keep their ids however often they are read.
    """
    last = log.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("last"))
    defaults: dict[str, object] = {time_col: ntz(as_of)}
    if "actor" in log.columns and actor is not None:
        defaults["actor"] = actor
    # The last id is a scalar subquery, one value whatever the log's size.
    rows = numbered(
        events.drop(id_col), path or work_dir(events.sparkSession, "append_log"), id_col, last.scalar() + F.lit(1), order
    )
    return _with_defaults(rows, log, defaults)


# ---- the control tables' own rules --------------------------------------------------------


@dataclass(frozen=True)
class WriteRule:
    """What a write changes in a row that is already there, and what it sets on its own.

    ``update`` columns come from the source; ``on_match`` and ``on_insert`` are fixed values;
    ``stamps`` take the time of the write when the row changes.
    """

    update: tuple[str, ...]
    on_match: Mapping[str, object] = field(default_factory=dict)
    on_insert: Mapping[str, object] = field(default_factory=dict)
    stamps: tuple[str, ...] = ("updated_at",)


WRITE_RULES: dict[str, WriteRule] = {
    "account_config": WriteRule(("config_value", "description")),
    # A changed connection has to be tested again.
    "external_connections": WriteRule(
        ("connection_type", "endpoint_url", "account_id", "secret_ref"), on_match={"status": "PENDING"}
    ),
    "naming_convention": WriteRule(("prefix", "suffix", "separator", "description", "enabled")),
    # An inactive project stays inactive.
    "projects": WriteRule(("project_name", "description", "dsi_db", "dso_db", "wh_size"), stamps=()),
    "managed_objects": WriteRule(("object_type", "object_name", "layer", "project_id", "metadata")),
    # Once the service has answered with an id the entry is active.
    "connectors": WriteRule(
        ("external_connector_id",), on_match={"status": "ACTIVE"}, on_insert={"status": "ACTIVE"}
    ),
    "transform_projects": WriteRule(
        ("external_id",), on_match={"status": "ACTIVE"}, on_insert={"status": "ACTIVE"}
    ),
}


def _insert_values(name: str, target: DataFrame, as_of) -> dict[str, object]:
    stamps = {c: ntz(as_of) for c in ("created_at", "updated_at") if c in target.columns}
    return {**stamps, **CONTROL_DEFAULTS.get(name, {})}


def write_control(name: str, target: DataFrame, source: DataFrame, as_of) -> DataFrame:
    """New state of control table ``name`` after writing ``source`` under the table's rule."""
    rule = WRITE_RULES[name]
    return upsert(
        target,
        source,
        CONTROL_KEYS[name],
        rule.update,
        {**_insert_values(name, target, as_of), **rule.on_insert},
        {**rule.on_match, **{c: ntz(as_of) for c in rule.stamps}},
    )


def register_pending(name: str, target: DataFrame, source: DataFrame, as_of) -> DataFrame:
    """Entries that wait for their service; what is registered already stays as it is."""
    return insert_if_absent(target, source, CONTROL_KEYS[name], _insert_values(name, target, as_of))


def deactivate_project(projects: DataFrame, project_id: str) -> DataFrame:
    return update_where(projects, F.col("project_id") == project_id, {"status": "INACTIVE"})


def record_connection_test(
    connections: DataFrame, name: str, status: str, message: str, as_of
) -> DataFrame:
    return update_where(
        connections,
        F.col("connection_name") == name,
        {"status": status, "last_test_at": ntz(as_of), "last_test_msg": message},
    )


def save_quota_config(config: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted edits (``users.accepted_changes``) written to the stored configuration."""
    return upsert(config, accepted, CONTROL_KEYS["warehouse_config"], EDITABLE)


def entry_key(project_id: str, name: str) -> Column:
    """Key of a connector or transform entry: ``<project>_<NAME_WITH_UNDERSCORES>``."""
    return F.concat_ws("_", project_id, F.replace(F.upper(name), F.lit(" "), F.lit("_")))


# Role types created with a project.
PROJECT_ROLE_TYPES = ("ADMIN", "DEVELOPER", "ANALYST")


def project_roles(projects: DataFrame) -> DataFrame:
    """``ROLE_<project>_<type>`` for every project, to be inserted where absent."""
    kinds = F.explode(F.array(*[F.lit(r) for r in PROJECT_ROLE_TYPES]))
    return projects.select("project_id", kinds.alias("role_type")).select(
        F.concat_ws("_", F.lit("ROLE"), "project_id", "role_type").alias("role_name"), "role_type", "project_id"
    )


# The naming rules a new installation starts with (layer, prefix).
NAMING_SEED = (("DSI", "DSI"), ("DSO", "DSO"), ("WH", "WH"), ("ROLE", "ROLE"), ("SCHEMA", None))


def seed_naming(rules: DataFrame, as_of) -> DataFrame:
    """The stored rules plus the initial ones that are missing."""
    seed = rules.sparkSession.createDataFrame(list(NAMING_SEED), "layer_code string, prefix string")
    return register_pending("naming_convention", rules, seed, as_of)


# ---- reading logs and control tables ---------------------------------------------------


def read_audit_log(
    log: DataFrame, event_type: str | None = None, status: str | None = None, k: int = 50
) -> DataFrame:
    rows = optional_filters(log, event_type=event_type, status=status)
    return top_k(rows, k, desc("event_time"), desc("log_id"))


def document(value: Column | str) -> Column:
    """A struct, map, array or JSON text as the JSON text that logs keep; text that is no JSON fails.

    Numbers, key order and spacing come out in one form, so equal documents are equal texts.
    """
    column = F.col(value) if isinstance(value, str) else value
    return F.parse_json(column.cast("string")).cast("string")


def detail(column: str, path: str, kind: str = "string") -> Column:
    """The value at a JSON ``path`` of a stored document; NULL where it lacks, is of another kind or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(F.col(column)), path, kind)


def audit_by_detail(log: DataFrame, path: str, value: object, kind: str = "string") -> DataFrame:
    """The actions whose details hold ``value`` at ``path``, newest first."""
    rows = log.where(detail("details", path, kind) == F.lit(value))
    return ordered(rows, desc("event_time"), desc("log_id"))


def document_schema(df: DataFrame, column: str) -> DataFrame:
    """``schema``: the one schema, as DDL text, that fits all stored documents; what is no JSON takes no part."""
    parsed = df.select(F.try_parse_json(F.col(column)).alias("_document"))
    return parsed.agg(F.schema_of_variant_agg("_document").alias("schema"))


def _alert_view(alerts: DataFrame) -> DataFrame:
    return alerts.withColumnRenamed("alert_time", "event_time")


def alert_history(alerts: DataFrame, start, end, k: int | None = 200) -> DataFrame:
    rows = period_filter(_alert_view(alerts), "event_time", start, end)
    return top_k(rows, k, desc("event_time"))


def serverless_alert_history(alerts: DataFrame, start, end, k: int = 200) -> DataFrame:
    services = (
        _alert_view(alerts.where(F.col("scope") == "SERVERLESS"))
        .drop("scope")
        .withColumnRenamed("resource_name", "service_type")
    )
    return top_k(period_filter(services, "event_time", start, end), k, desc("event_time"))


def alert_kpis(alerts: DataFrame, start, end, k: int | None = None) -> DataFrame:
    """Alerts of the period: total, critical ones and resources concerned; ``k`` as in :func:`alert_history`."""
    return alert_history(alerts, start, end, k).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").rlike("CRITICAL|SUSPENDED|EXCEEDED")).alias("critical"),
        F.countDistinct("resource_name").alias("resources"),
    )


def alert_status_counts(alerts: DataFrame, start, end, k: int | None = None) -> DataFrame:
    return alert_history(alerts, start, end, k).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def execution_history(log: DataFrame, start, end, k: int | None = 100) -> DataFrame:
    return top_k(period_filter(log, "execution_time", start, end), k, desc("execution_time"))


def execution_kpis(log: DataFrame, start, end, k: int | None = None) -> DataFrame:
    return execution_history(log, start, end, k).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("status") == "ERROR").alias("failed"),
    )


def inventory_counts(
    projects: DataFrame, roles: DataFrame, objects: DataFrame, audit: DataFrame
) -> DataFrame:
    """Number of projects, managed roles, managed objects and audited actions."""
    kinds = {"projects": projects, "roles": roles, "objects": objects, "audited_actions": audit}
    stacked = union_all(*[df.select(F.lit(kind).alias("kind")) for kind, df in kinds.items()])
    return stacked.agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds])


def objects_per_layer(objects: DataFrame) -> DataFrame:
    out = objects.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("layer") == "DSI").alias("dsi"),
        F.count_if(F.col("layer") == "DSO").alias("dso"),
    )
    return ordered(out, asc("project_id"))


def managed_objects(
    objects: DataFrame, project_id: str | None = None, layer: str | None = None
) -> DataFrame:
    rows = optional_filters(objects, project_id=project_id, layer=layer)
    return ordered(rows, asc("layer"), asc("object_type"), asc("object_name"))


def active_projects(projects: DataFrame) -> DataFrame:
    rows = projects.where(F.col("status") == "ACTIVE").select(
        "project_id", "project_name", "dsi_db", "dso_db", "wh_size", "status"
    )
    return ordered(rows, asc("project_name"))


CONNECTOR_COLUMNS = (
    "connector_key",
    "connector_name",
    "service",
    "destination_schema",
    "dsi_db",
    "external_connector_id",
    "status",
    "created_at",
)


def connector_listing(connectors: DataFrame, project: str, active_only: bool = False) -> DataFrame:
    """Connectors of a project, newest first; or those that are ACTIVE with an external id."""
    rows = connectors.where(F.col("project_id") == project)
    if active_only:
        rows = rows.where((F.col("status") == "ACTIVE") & (F.col("external_connector_id") != ""))
    return ordered(rows.select(*CONNECTOR_COLUMNS), desc("created_at"), asc("connector_key"))


# Symbols of the connection states.
STATUS_SYMBOLS = {"CONNECTED": "✅", "ERROR": "❌", "PENDING": "🔄"}
UNKNOWN_SYMBOL = "❓"


def connection_status(connections: DataFrame) -> DataFrame:
    symbol = F.lit(UNKNOWN_SYMBOL)
    for status, mark in STATUS_SYMBOLS.items():
        symbol = F.when(F.col("status") == status, mark).otherwise(symbol)
    return ordered(connections.withColumn("symbol", symbol), asc("connection_name"))


# ---- generated names --------------------------------------------------------------------


def _joined_name(*parts: Column) -> Column:
    """Non-empty parts joined by the rule's separator (``_`` when it has none)."""
    separator = F.coalesce(F.nullif("separator", F.lit("")), F.lit("_"))
    # concat_ws leaves NULL parts out but keeps empty ones.
    return F.call_function("concat_ws", separator, *[F.nullif(p, F.lit("")) for p in parts])


def preview_names(rules: DataFrame, project: str) -> DataFrame:
    """The name every enabled rule gives to one project; an empty prefix is left out."""
    out = rules.where(F.col("enabled")).select(
        "layer_code",
        F.lit(project.upper()).alias("project_id"),
        _joined_name(F.col("prefix"), F.lit(project.upper()), F.col("suffix")).alias(
            "generated_name"
        ),
        "description",
    )
    return ordered(out, asc("layer_code"))


def name_objects(
    rules: DataFrame, requests: DataFrame, name: str | None = None, fallback_to_layer: bool = True
) -> DataFrame:
    """Names for requested objects (``layer_code, project_id`` and maybe a name column).

    An equi-join on the layer.  A layer without an enabled rule is named
    ``<layer>_<PROJECT>[_<NAME>]``; with ``fallback_to_layer`` an empty prefix is replaced
    by the layer code.
    """
    enabled = rules.where(F.col("enabled")).select(
        "layer_code", "prefix", "suffix", "separator", "description", F.lit(True).alias("has_rule")
    )
    joined = requests.join(enabled, "layer_code", "left")
    prefix = F.when(F.col("prefix") != "", F.col("prefix"))
    use_layer = F.lit(True) if fallback_to_layer else F.col("has_rule").isNull()
    prefix = F.coalesce(prefix, F.when(use_layer, F.col("layer_code")))
    parts = [prefix, F.upper("project_id")]
    if name is not None:
        parts.append(F.upper(name))
    parts.append(F.col("suffix"))
    carried = [name] if name is not None else []
    return joined.select(
        "layer_code",
        "project_id",
        *carried,
        _joined_name(*parts).alias("generated_name"),
        "description",
    )
