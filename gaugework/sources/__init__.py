from gaugework.sources.catalog import UsageCatalog, config_value, lookup, scan_control, scan_usage
from gaugework.sources.files import load_files
from gaugework.sources.tables import (
    VersionedTable,
    clustered,
    write_clustered,
    write_table,
    write_usage_log,
)

__all__ = [
    "UsageCatalog",
    "VersionedTable",
    "clustered",
    "config_value",
    "load_files",
    "lookup",
    "scan_control",
    "scan_usage",
    "write_clustered",
    "write_table",
    "write_usage_log",
]
