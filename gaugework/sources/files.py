"""Loading files into landing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "parquet", "avro", "orc")
CORRUPT = "_corrupt_record"
SOURCE_FILE = "_source_file"

# A line is a record, so that large files are read by many tasks.  Quoted text with line
# breaks needs the option multiLine=true, at the price of one task per file.
_READ_OPTIONS: dict[str, dict[str, str]] = {
    "csv": {"header": "true", "escape": '"', "mode": "PERMISSIVE"},
    "json": {"mode": "PERMISSIVE"},
}


def with_corrupt_column(fmt: str, schema: T.StructType) -> T.StructType:
    """Text formats keep rows that do not parse; they land in ``_corrupt_record``."""
    if fmt in ("csv", "json"):
        return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return schema


def check_format(fmt: str) -> str:
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    return fmt


def reader_options(fmt: str, options: dict[str, str] | None = None) -> dict[str, str]:
    return {**_READ_OPTIONS.get(fmt, {}), **(options or {})}


def load_files(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType,
    options: dict[str, str] | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Rows of the files under ``path`` with their ``_source_file``.

    The schema is given, never inferred: no extra pass over the files.  A record that does not
    parse fails the load; ``keep_corrupt`` lands it in ``_corrupt_record`` instead.  Avro needs the
    spark-avro package on the classpath.
    """
    fmt = check_format(fmt)
    settings = reader_options(fmt, options)
    if keep_corrupt:
        full = with_corrupt_column(fmt, schema)
    else:
        full = schema
        if "mode" in settings and "mode" not in (options or {}):
            settings["mode"] = "FAILFAST"
    df = spark.read.format(fmt).options(**settings).schema(full).load(path)
    return df.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
