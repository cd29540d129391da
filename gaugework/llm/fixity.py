"""Fixity audit of WARC replicas by hash trees over ordered offset ranges.

Every record is hashed where it is read, so only (file, offset, length, digest) travels.  Records are
gathered by offset range, ranges into nodes of up to ``FANOUT`` children, the nodes of a file
into its root, files into nodes and so on up to one root per replica.  Each group has a bounded
size whatever the archive's: a range holds ``RANGE_BYTES`` of record starts, a node its children.

An audit compares the roots and then, level by level, only the children of nodes that
differ.  Below an equal node nothing is read.

Rows that repeat an id are records of their own.  They follow each other in a fixed order that starts with their
digests, numbered by sums over digest prefixes, so an id that holds a third of all rows is dealt over many tasks.

Defined cases: records without id have no place in the archive; of the records of one id, those with equal digests are
matched first and the others in their order; NULL URLs and bodies are empty; a record that one side lacks is ``missing`` or
``extra``; empty replicas are equal; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.shared import saved

FANOUT = 64
RANGE_BYTES = 1 << 16
RECORDS_PER_FILE = 1000
#: Hexadecimal digits of the digest, and equal records, by which the records of one id are dealt out.
PREFIX, COPIES = 3, 1024


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a response record, as text."""
    payload = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        record_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
        payload,
        F.lit("\r\n\r\n"),
    )


def digests(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, digest, length, copy`` of every record; ``copy`` counts equal ones."""
    record = warc_record(F.col(id_col), F.col("url"), F.col("html"))
    rows = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.sha2(record.cast("binary"), 256).alias("digest"),
        F.octet_length(record).cast("bigint").alias("length"),
    )
    counted = rows.groupBy("id", "digest", "length").agg(F.count("*").alias("n"))
    return counted.select("id", "digest", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"))


def _numbered(records: DataFrame) -> DataFrame:
    """Adds ``at`` and ``before``: how many records, and bytes, of the same id precede each."""
    part = [F.substring("digest", 1, PREFIX).alias("_prefix"), _divided(F.col("copy"), COPIES).alias("_copies")]
    dealt = records.select("*", *part)
    parts = dealt.groupBy("id", "_prefix", "_copies").agg(F.count("*").alias("_n"), F.sum("length").alias("_bytes"))
    earlier = Window.partitionBy("id").orderBy("_prefix", "_copies").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("id").alias("_id"),
        F.col("_prefix").alias("_p"),
        F.col("_copies").alias("_c"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"),
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy("id", "_prefix", "_copies").orderBy("digest", "length", "copy")
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns(
        {"_row": F.row_number().over(within) - 1, "_before": F.coalesce(F.sum("length").over(running), F.lit(0))}
    )
    here = (F.col("id") == F.col("_id")) & (F.col("_prefix") == F.col("_p")) & (F.col("_copies") == F.col("_c"))
    return own.join(starts, here).select(
        *records.columns, (F.col("_first") + F.col("_row")).alias("at"), (F.col("_start") + F.col("_before")).alias("before")
    )


def placed(records: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Adds ``file`` and ``offset``: records follow each other by id, ``per_file`` ids a file."""
    before = Window.partitionBy("file").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    # One row per id, so at most ``per_file`` in a window.
    ids = records.groupBy(F.col("id").alias("_id")).agg(F.sum("length").alias("_bytes"))
    ids = ids.withColumn("file", _divided(F.col("_id"), per_file))
    ids = ids.select("_id", "file", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"))
    filed = _numbered(records).join(ids, F.col("id") == F.col("_id"))
    return filed.select(*records.columns, "file", (F.col("_base") + F.col("before")).alias("offset"))


def held(records: DataFrame, original: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Gives the ``records`` of a replica the places of the ``original`` (as from ``placed``).

    Equal records take the place of their like, the others of an id its free places in their order, and what
    then is left follows the first byte of the id's last record.
    """
    same = ["id", "digest", "length", "copy"]
    records, original = saved(records.select(*same)), original.select(*same, "file", "offset")
    equal = records.join(original, same)
    own = saved(_numbered(records.join(original, same, "left_anti")))
    free = _numbered(original.join(records, same, "left_anti")).select("id", "at", "file", "offset")
    ends = original.groupBy("id").agg((F.max("offset") + 1).alias("_end"))
    moved = own.join(free, ["id", "at"], "left").join(ends.join(own.select("id"), "id", "left_semi"), "id", "left")
    moved = moved.withColumns(
        {
            "file": F.coalesce("file", _divided(F.col("id"), per_file)),
            "offset": F.coalesce("offset", F.coalesce("_end", F.lit(0)) + F.col("before")),
        }
    )
    return equal.unionByName(moved.select(*equal.columns))


def _divided(x: Column, n: int) -> Column:
    """Integer division that rounds down."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def _parents(level: DataFrame, children: str, file: Column, node: Column) -> DataFrame:
    """Group a level by ``up_file, up_node``: the hash of the ordered hashes of the children."""
    ordered = F.sort_array(F.collect_list(F.struct(children, "hash")))
    text = F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", c[children].cast("string"), c["hash"])), "\n")
    nodes = level.groupBy(F.col("up_file").alias("file"), F.col("up_node").alias("node")).agg(
        F.sha2(text.cast("binary"), 256).alias("hash")
    )
    return saved(nodes.withColumns({"up_file": file, "up_node": node}))


def _height(n: int) -> int:
    """Divisions by the fan-out that bring ``n`` to 0."""
    height = 0
    while n > 0:
        n, height = n // FANOUT, height + 1
    return height


def trees(*replicas: DataFrame) -> list[list[DataFrame]]:
    """A hash tree per replica, all of one shape: levels from the records up to one root.

    Replicas hold ``id, file, offset, length, digest``.  Levels hold ``file, node, hash`` and the place
    ``up_file, up_node`` of their parent.
    """
    leaves = []
    for records in replicas:
        range_of = _divided(F.col("offset"), RANGE_BYTES)
        named = records.select("id", "file", "offset", "length", "digest")
        named = named.withColumn("hash", F.concat_ws(":", F.col("length").cast("string"), "digest"))
        leaves.append(saved(named.withColumns({"up_file": F.col("file"), "up_node": range_of})))
    bounds = [x.agg(F.min("file"), F.max("file"), F.max("up_node")).first() for x in leaves]
    bounds = [b for b in bounds if b[0] is not None] or [(0, 0, 0)]
    first, last = min(b[0] for b in bounds), max(b[1] for b in bounds)
    in_file, above = _height(max(b[2] for b in bounds)), _height(last - first)
    higher = _divided(F.col("node"), FANOUT)
    made = []
    for own in leaves:
        levels, order = [own], "offset"
        for left in range(in_file, -1, -1):
            # A file's root is node 0; its parent is a node of the archive, under file -1.
            if left:
                file, node = F.col("file"), higher
            else:
                file, node = F.lit(-1).cast("bigint"), _divided(F.col("file") - F.lit(first), FANOUT)
            levels.append(_parents(levels[-1], order, file, node))
            order = "node"
        order = "file"
        for _ in range(max(above, 1)):
            levels.append(_parents(levels[-1], order, F.col("file"), higher))
            order = "node"
        made.append(levels)
    return made


def _differing(own: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    mine = own.select(*keys, F.col(value).alias("_own"))
    theirs = other.select(*keys, F.col(value).alias("_other"))
    return mine.join(theirs, keys, "full_outer").where(~F.col("_own").eqNullSafe(F.col("_other")))


def audit(own: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """``file, offset, id, fault`` of every record in which the replica differs from the first tree."""
    where = None
    for mine, theirs in zip(own[:0:-1], other[:0:-1], strict=True):
        if where is not None:
            mine, theirs = (x.join(where, ["up_file", "up_node"], "left_semi") for x in (mine, theirs))
        bad = _differing(mine, theirs, ["file", "node"], "hash")
        where = saved(bad.select(F.col("file").alias("up_file"), F.col("node").alias("up_node")))
    mine, theirs = (x[0].join(where, ["up_file", "up_node"], "left_semi") for x in (own, other))
    found = _differing(mine, theirs, ["file", "offset", "id"], "hash")
    fault = F.when(F.col("_other").isNull(), "missing").when(F.col("_own").isNull(), "extra").otherwise("changed")
    return found.select("file", "offset", "id", fault.alias("fault"))
