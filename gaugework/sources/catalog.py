"""Reading usage logs and control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions import asc, desc
from gaugework.operators.filters import partition_column
from gaugework.schemas import USAGE_LOGS

CONTROL_ORDER: dict[str, tuple[str, ...]] = {
    "naming_convention": ("layer_code",),
    "projects": ("-created_at", "project_id"),
    "managed_roles": ("project_id", "role_type", "role_name"),
    "external_connections": ("connection_name",),
    "account_config": ("config_key",),
    "warehouse_config": ("warehouse_name",),
    "serverless_config": ("service_type",),
}


class UsageCatalog:
    """Usage logs stored as Parquet under one root, one folder per log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return scan_usage(self.spark, self.root, name)


def scan_usage(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A usage log by name, with the columns the operators know.

    Flags stored as text become booleans and zoned timestamps become wall-clock time;
    a column that is already right stays a bare reference, so its filters are pushed.
    A missing column raises: an empty result would look like "no usage".
    """
    if name not in USAGE_LOGS:
        raise KeyError(f"unknown usage log: {name}")
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    found = dict(df.dtypes)
    columns = []
    for field in USAGE_LOGS[name].fields:
        if field.name not in found:
            raise ValueError(f"{name} lacks column {field.name}")
        c, kind = F.col(field.name), found[field.name]
        if kind != field.dataType.simpleString():
            cast = c.try_cast if kind == "string" else c.cast
            c = cast(field.dataType).alias(field.name)
        columns.append(c)
    dates = [partition_column(f.name) for f in USAGE_LOGS[name].fields]
    return df.select(*columns, *[d for d in dates if d in found])


def scan_control(df: DataFrame, name: str) -> DataFrame:
    """All rows of a control table in its display order."""
    keys = [
        desc(key[1:]) if key.startswith("-") else asc(key) for key in CONTROL_ORDER[name]
    ]
    return df.orderBy(*keys)


def lookup(df: DataFrame, key_col: str, key, enabled_only: bool = False) -> DataFrame:
    """The 0 or 1 rows of a key; ``enabled_only`` for naming rules."""
    rows = df.where(F.col(key_col) == F.lit(key))
    return rows.where(F.col("enabled")) if enabled_only else rows


def config_value(df: DataFrame, key: str) -> DataFrame:
    """A configuration value as text, JSON quoting removed."""
    text = F.parse_json("config_value").cast("string")
    return lookup(df, "config_key", key).select("config_key", text.alias("config_value"))
