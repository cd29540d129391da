"""File loads, landing tables and layout.

These write under the shared work folder first, so they also show the sinks at work.
"""

from pyspark.sql import functions as F

from gaugework.operators import landing as op
from gaugework.operators.control import upsert
from gaugework.operators.filters import period_filter
from gaugework.sources import (
    UsageCatalog,
    VersionedTable,
    load_files,
    write_clustered,
    write_table,
    write_usage_log,
)

from checks.registry import scratch, END, PERIOD, START, query

ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _round_trip(fmt: str, table: str):
    def run(t):
        df = t.table(table)
        path = scratch(t.spark, f"load-{fmt}")
        writer = df.write.format(fmt)
        options = {}
        if fmt == "csv":
            writer = writer.options(header="true", escape='"')
            options["multiLine"] = "true"  # the texts have line breaks
        writer.save(path)
        return load_files(t.spark, path, fmt, df.schema, options).drop("_source_file")

    return run


query("load_files_parquet", "", ORDERS_SQL)(_round_trip("parquet", "orders"))
query("load_files_orc", "", ORDERS_SQL)(_round_trip("orc", "orders"))
query("load_files_csv", "", "SELECT doc_id, text, lang, source, n_chars FROM documents")(_round_trip("csv", "documents"))
query("load_files_json", "", "SELECT doc_id, text, lang, source, n_chars FROM documents")(_round_trip("json", "documents"))


def _load_with_errors(t):
    """Orders as CSV lines, one folder per status; prices of status P do not parse."""
    path = scratch(t.spark, "load-errors")
    orders = t.table("orders")
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    lines = orders.select(
        F.col("o_orderstatus").alias("folder"), F.concat_ws(",", "o_orderkey", price).alias("value")
    )
    lines.write.partitionBy("folder").text(path)
    loaded = load_files(
        t.spark,
        f"{path}/folder=*",
        "csv",
        orders.select("o_orderkey", F.col("o_totalprice")).schema,
        {"header": "false"},
        keep_corrupt=True,
    )
    landed = f"{path}-landed"
    write_table(loaded, landed)
    return op.load_log(t.spark.read.parquet(landed), END)


@query(
    "load_log",
    "",
    f"""SELECT o_orderstatus AS folder, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS row_count, count(*) AS row_parsed,
               count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS error_count,
               CASE WHEN o_orderstatus = 'P' THEN 'LOAD_FAILED' ELSE 'LOADED' END AS status,
               TIMESTAMP '{END}' AS last_load_time
        FROM orders GROUP BY o_orderstatus""",
)
def _(t):
    # File names differ from run to run; their folders do not.
    folder = F.regexp_extract("file_name", "folder=([A-Z])", 1)
    return (
        _load_with_errors(t)
        .groupBy(folder.alias("folder"))
        .agg(
            F.sum("row_count").alias("row_count"),
            F.sum("row_parsed").alias("row_parsed"),
            F.sum("error_count").alias("error_count"),
            F.max("status").alias("status"),
            F.max("last_load_time").alias("last_load_time"),
        )
    )


# ---- versions of a business key -------------------------------------------------------------


def _landed_documents(t):
    """Documents landed by source file; copies share the key, which is the text."""
    docs = t.table("documents")
    return op.landing_enrich(
        docs.select("text", "lang", "n_chars"), END, source_file=F.lit("documents")
    )


# Equal rows must have equal hashes and different rows different ones, so the number of
# hashes and of rows per content is what is compared.
@query(
    "landing_enrich",
    "",
    f"""SELECT text, lang, n_chars, TIMESTAMP '{END}' AS _loaded_at, 'documents' AS _source_file, true AS _is_current,
               CAST(1 AS BIGINT) AS hashes, CAST(64 AS INTEGER) AS hash_length, count(*) AS copies
        FROM documents GROUP BY text, lang, n_chars""",
)
def _(t):
    landed = _landed_documents(t)
    return landed.groupBy("text", "lang", "n_chars", "_loaded_at", "_source_file", "_is_current").agg(
        F.countDistinct("_row_hash").alias("hashes"),
        F.max(F.length("_row_hash")).alias("hash_length"),
        F.count(F.lit(1)).alias("copies"),
    )


@query(
    "row_hash_groups",
    "",
    "SELECT count(*) AS copies, lang FROM documents GROUP BY text, lang, n_chars",
)
def _(t):
    return _landed_documents(t).groupBy("_row_hash", "lang").agg(F.count(F.lit(1)).alias("copies")).drop("_row_hash")


def _order_versions(t):
    """Orders as versions of their customer, loaded on the order date."""
    orders = t.table("orders")
    enriched = op.landing_enrich(
        orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"),
        END,
        source_file=F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")),
    )
    return enriched.withColumn("_loaded_at", F.col("o_orderdate")).drop("o_orderdate")


VERSIONS = """SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate AS _loaded_at,
                     'f' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS _source_file,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS _is_current
              FROM orders"""


@query("mark_current", "", VERSIONS)
def _(t):
    return op.mark_current(_order_versions(t), ["o_custkey"]).drop("_row_hash")


@query("current_rows", "", f"SELECT * FROM ({VERSIONS}) WHERE _is_current")
def _(t):
    return op.current_rows(op.mark_current(_order_versions(t), ["o_custkey"])).drop("_row_hash")


@query("latest_versions", "", f"SELECT * FROM ({VERSIONS}) WHERE _is_current")
def _(t):
    return op.latest_versions(_order_versions(t), ["o_custkey"]).drop("_row_hash")


def _customer_landing(t, price, at):
    orders = t.table("orders").groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("last_order"), F.round(F.max("o_totalprice")).alias("largest")
    )
    return op.landing_enrich(orders.withColumn("largest", price), at, source_file=F.lit("batch"))


@query(
    "append_versions",
    "",
    """
    WITH c AS (SELECT o_custkey, max(o_orderkey) AS last_order, round(max(o_totalprice)) AS largest FROM orders GROUP BY 1)
    SELECT o_custkey, last_order, largest, TIMESTAMP '2001-08-02' AS _loaded_at, 'batch' AS _source_file,
           largest <= 400000 AS _is_current FROM c
    UNION ALL
    SELECT o_custkey, last_order, largest + 1, TIMESTAMP '2001-08-03', 'batch', true FROM c WHERE largest > 400000""",
)
def _(t):
    stored = _customer_landing(t, F.col("largest"), "2001-08-02")
    changed = F.when(F.col("largest") > 400000, F.col("largest") + 1).otherwise(F.col("largest"))
    batch = _customer_landing(t, changed, "2001-08-03")
    return op.append_versions(stored, batch, ["o_custkey"]).drop("_row_hash")


# ---- sinks -----------------------------------------------------------------------------------


@query("write_table", "", ORDERS_SQL)
def _(t):
    path = scratch(t.spark, "table")
    write_table(t.table("orders"), path, partition_by=["o_orderpriority"])
    return t.spark.read.parquet(path)


@query("write_clustered", "", ORDERS_SQL)
def _(t):
    path = scratch(t.spark, "clustered")
    write_clustered(t.table("orders"), path, "o_orderstatus")
    return t.spark.read.parquet(path)


@query(
    "usage_log_scan",
    "warehouse_metering_history",
    f"""SELECT warehouse_name, start_time, end_time, credits_used, credits_used_compute, credits_used_cloud_services,
               CAST(start_time AS DATE) AS start_time_date FROM warehouse_metering_history WHERE start_time {PERIOD}""",
)
def _(t):
    root = scratch(t.spark, "logs")
    write_usage_log(t("warehouse_metering_history"), f"{root}/warehouse_metering_history", "start_time")
    log = UsageCatalog(t.spark, root).table("warehouse_metering_history")
    return period_filter(log, "start_time", START, END)


@query(
    "versioned_upsert",
    "projects",
    """
    SELECT coalesce(p.project_id, s.project_id) AS project_id, coalesce(s.project_name, p.project_name) AS project_name,
           p.description, p.dsi_db, p.dso_db, p.wh_size, coalesce(p.status, 'ACTIVE') AS status, p.created_at
    FROM projects p FULL JOIN (SELECT 'P' || CAST(c_custkey AS VARCHAR) AS project_id, c_name AS project_name FROM customer) s
      ON p.project_id = s.project_id""",
)
def _(t):
    table = VersionedTable(t.spark, scratch(t.spark, "projects"))
    table.write(t("projects"))
    edits = t.table("customer").select(
        F.concat(F.lit("P"), F.col("c_custkey")).alias("project_id"), F.col("c_name").alias("project_name")
    )
    for _ in range(2):  # the second time changes nothing
        table.write(upsert(table.read(), edits, ["project_id"], ["project_name"], {"status": "ACTIVE"}))
    return table.read()
