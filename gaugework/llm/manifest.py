"""A Merkle manifest of a dataset: a tree of leaf digests per group, a tree over the groups, and proofs.

Within a group leaves stand in the order of their ids.  Where a leaf stands is looked up, not sorted:

1. Every group gets a compressed bitmap of its ids, kept as its words of 64 ids that are not empty.  Words are built
   per task and merged by OR; ``PER_BLOCK`` words are a block.
2. A directory holds how many leaves stand before each block.  It is a tree of counts over the id space: every level adds up
   at most ``FAN`` nodes below one parent, so no running sum is longer than that, however many ids there are.
3. A leaf's place is the count before its block, plus the popcount of the words and bits before its own.

Then the tree is built in rounds.  A node's place gives its key (group, place div ``arity^height``) and its slot; the at most
``SLOTS`` nodes of a key form an array that one task reduces by ``height`` levels to one node of the next round.  The arrays are
written out, and the proofs are read off them from the root down.  Groups are put in order by a distributed numbering, so there
may be any number of them.

Defined cases: a NULL group is one of its own and the first; NULL ids come before all others.  Leaves that share a group and an
id stand by their digest, and equal ones take places of their own; both are found as words that hold
more leaves than bits, and only those are counted one by one, spread over the first bits of the digest and with copies
counted before they travel.  An empty table gives no rows; the root of a single leaf is the leaf itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.numbering import numbered
from gaugework.llm.shared import shared_path, written

WORD_BITS = 6
#: Words of a block, and children of a node of the directory, both as bits.
PER_BLOCK, FAN = 2, 10
#: Most nodes that one task reduces together.
SLOTS = 256
#: Rows that copies of one leaf are dealt out by.
COPIES = 4096
_FLIP = -(1 << 63)


def node_digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields in a row: ``-`` for NULL, else byte count, ``:`` and the text."""
    texts = [f.cast("string") for f in fields]
    coded = [
        F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts
    ]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def _located(leaves: DataFrame) -> DataFrame:
    """With ``word`` and ``bit`` of the id; unsigned order keeps negative ids first, NULL ids are before all."""
    word = F.shiftrightunsigned(F.col("id").bitwiseXOR(F.lit(_FLIP)), WORD_BITS) + 1
    bit = F.col("id").bitwiseAND((1 << WORD_BITS) - 1)
    return leaves.withColumns(
        {"word": F.coalesce(word, F.lit(0)).cast("bigint"), "bit": F.coalesce(bit, F.lit(0)).cast("int")}
    ).withColumn("block", F.shiftright("word", PER_BLOCK))


def _running(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """With ``before``, the sum of ``n`` over the rows before this one among those that share ``by``."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)).cast("bigint"))


def directory(located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tree, block, start, words`` and ``tree, n``: the merged bitmaps with counts before each block, and the sizes.

    ``words`` are ``word, bits, n``; a word that has more leaves ``n`` than ``bits`` holds repeated ids.
    """
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    words = located.groupBy("tree", "block", "word").agg(F.bit_or(one).alias("bits"), F.count("*").alias("n"))
    blocks = written(
        words.groupBy("tree", "block").agg(
            F.sort_array(F.collect_list(F.struct("word", "bits", "n"))).alias("words"), F.sum("n").alias("n")
        )
    )
    least, most = blocks.agg(F.min("block"), F.max("block")).first()
    nodes, levels = blocks.select("tree", F.col("block").alias("node"), "n"), []
    while least != most:
        levels.append(_running(nodes.withColumn("parent", F.shiftright("node", FAN)), ["tree", "parent"], "node"))
        nodes = nodes.groupBy("tree", F.shiftright("node", FAN).alias("node")).agg(F.sum("n").alias("n"))
        least, most = least >> FAN, most >> FAN
    starts = nodes.select("tree", "node", F.lit(0).cast("bigint").alias("start"))
    for level in reversed(levels):
        above = starts.withColumnRenamed("node", "parent")
        starts = level.join(above, ["tree", "parent"]).select("tree", "node", (F.col("start") + F.col("before")).alias("start"))
    found = blocks.drop("n").join(starts.withColumnRenamed("node", "block"), ["tree", "block"])
    return written(found), written(nodes.select("tree", "n"))


def _before(words: str, word: str) -> Column:
    """Leaves of the block in words before ``word``."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.when(w["word"] < F.col(word), w["n"]).otherwise(0))


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (``tree, id, leaf, shown``) plus ``index``, the place in their tree, and the size of every tree."""
    located = _located(leaves)
    found, sizes = directory(located)
    crowded = F.exists("words", lambda w: (w["word"] == F.col("word")) & (w["n"] > F.bit_count(w["bits"])))
    rows = located.join(found, ["tree", "block"]).withColumn("crowded", crowded)
    own = F.get(F.filter("words", lambda w: w["word"] == F.col("word")), F.lit(0))["bits"]
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("bit")))
    index = F.col("start") + _before("words", "word") + F.bit_count(own.bitwiseAND(below))
    columns = ["tree", "index", "id", "leaf", "shown"]
    plain = rows.where(~F.col("crowded")).withColumn("index", index.cast("bigint")).select(*columns)
    repeats = F.exists("words", lambda w: w["n"] > F.bit_count(w["bits"]))
    if found.where(repeats).isEmpty():
        return plain, sizes
    start = (F.col("start") + _before("words", "word")).alias("start")
    kinds = written(
        rows.where("crowded")
        .select("tree", "word", "bit", "id", "leaf", "shown", start)
        .groupBy("tree", "word", "bit", "id", "leaf", "shown", "start")
        .agg(F.count("*").alias("n"))
        .withColumn("first", F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int"))
    )
    keys: list[str] = ["tree", "word"]
    ranked = kinds.withColumn("index", F.col("start"))
    for step in ("bit", "first"):
        summed = kinds.groupBy(*keys, step).agg(F.sum("n").alias("n"))
        ranked = ranked.join(_running(summed, keys, step).drop("n"), [*keys, step])
        ranked = ranked.withColumn("index", F.col("index") + F.col("before")).drop("before")
        keys.append(step)
    ranked = _running(ranked, keys, "leaf", "shown").withColumn("index", F.col("index") + F.col("before"))
    # Copies of a leaf are made from its count, dealt out in runs.
    runs = ranked.select(*columns, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))).alias("_run"))
    last = F.least(F.col("_run") + COPIES, F.col("n")) - 1
    each = runs.hint("rebalance").withColumn("_copy", F.explode(F.sequence(F.col("_run"), last)))
    repeated = each.withColumn("index", F.col("index") + F.col("_copy")).select(*columns)
    return plain.unionByName(repeated), sizes


class Shape:
    """Runs of ``arity`` nodes; ``height`` levels are reduced together."""

    def __init__(self, arity: int) -> None:
        if arity < 2:
            raise ValueError("a node has at least two children")
        self.arity, self.height, self.width = arity, 1, arity
        while self.width * arity <= SLOTS:
            self.width *= arity
            self.height += 1

    def levels(self, nodes: int) -> int:
        """Levels that a slot array of a tree with so many nodes is reduced by."""
        if nodes > self.width:
            return self.height
        levels, reach = 0, 1
        while reach < nodes:
            levels, reach = levels + 1, reach * self.arity
        return levels

    def reduced(self, digests: list[str], nodes: int) -> list[list[str]]:
        """The digests of all levels, from the given ones to the last."""
        rows = [digests]
        for _ in range(self.levels(nodes)):
            below = rows[-1]
            rows.append([node_digest("".join(below[i : i + self.arity])) for i in range(0, len(below), self.arity)])
        return rows

    def siblings(self, rows: list[list[str]], slot: int) -> list[tuple[str, str]]:
        """What stands left and right of a slot's ancestors within their runs, level by level."""
        found = []
        for level in rows[:-1]:
            run = slot - slot % self.arity
            found.append(("".join(level[run:slot]), "".join(level[slot + 1 : run + self.arity])))
            slot //= self.arity
        return found


def _slots(nodes: DataFrame, sizes: DataFrame, shape: Shape) -> DataFrame:
    """Nodes as arrays by key: ``tree, chunk, nodes, slots``; ``slots`` hold ``index, digest`` and other columns."""
    others = [c for c in nodes.columns if c not in ("tree", "index")]
    keyed = nodes.withColumn("chunk", F.expr(f"index div {shape.width}"))
    arrays = keyed.groupBy("tree", "chunk").agg(F.sort_array(F.collect_list(F.struct("index", *others))).alias("slots"))
    return written(arrays.join(sizes.withColumnRenamed("n", "nodes"), "tree"))


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in text.split(";")] if text else []


def _text(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left}|{right}" for left, right in path)


def _tops(slots: DataFrame, shape: Shape) -> DataFrame:
    """``tree, index, digest`` of the nodes that slot arrays are reduced to."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [
                shape.reduced([d.hex() for d in digests], nodes)[-1][0]
                for digests, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            digests = pa.array([bytes.fromhex(t) for t in tops], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests], names=["tree", "index", "digest"])

    digests = F.col("slots.digest").alias("digests")
    return slots.select("tree", "chunk", digests, "nodes").mapInArrow(top, "tree string, index bigint, digest binary")


def built(nodes: DataFrame, sizes: DataFrame, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of every round, and ``tree, digest`` of the roots.

    A tree that is down to one node waits, as an array of one slot that is not reduced, until all are.
    """
    rounds = []
    while True:
        slots = _slots(nodes, sizes, shape)
        rounds.append(slots)
        nodes = _tops(slots, shape)
        if not sizes.agg(F.max("n")).first()[0] > shape.width:
            return rounds, nodes.select("tree", "digest")
        sizes = sizes.withColumn("n", F.expr(f"(n + {shape.width - 1}) div {shape.width}"))


def _descend(slots: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """``tree, index, path`` and the columns of ``above`` for every slot; ``above`` has ``tree, index, path`` of the arrays."""
    joined = slots.join(above.withColumnRenamed("index", "chunk"), ["tree", "chunk"])
    kept = [c for c in above.columns if c not in ("tree", "index", "path")]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, at, paths = [], [], []
            for row, (own, digests, nodes, path) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)):
                rows = shape.reduced([d.hex() for d in digests], nodes)
                for slot, place in enumerate(own):
                    index.append(place)
                    at.append(row)
                    paths.append(";".join(p for p in (_text(shape.siblings(rows, slot)), path) if p))
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), pa.array(index, pa.int64()), pa.array(paths, pa.string())]
                + [batch.column(5 + i).take(taken) for i in range(len(kept))],
                names=["tree", "index", "path", *kept],
            )

    parts = [F.col(f"slots.{c}").alias(f"_{c}") for c in ("index", "digest")]
    shape_of = "tree string, index bigint, path string" + "".join(f", {c} string" for c in kept)
    return joined.select("tree", *parts, "nodes", "path", *kept).mapInArrow(spread, shape_of)


def _proved(slots: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """The result rows: leaves with their proofs, and the roots recomputed from what is shown."""
    joined = slots.join(above.withColumnRenamed("index", "chunk"), ["tree", "chunk"])
    names = ["id", "leaf", "index", "subroot", "root", "proof", "folded_root", "verified"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ids, index, digests, shown, nodes, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                leaves = [d.hex() for d in digests]
                rows, over = shape.reduced(leaves, nodes), _path(path)
                for slot, leaf in enumerate(leaves):
                    levels = shape.siblings(rows, slot) + over
                    folded = shown[slot].hex() if shown[slot] is not None else leaf
                    for left, right in levels:
                        folded = node_digest(left + folded + right)
                    proof = [side for level in levels for side in level if side]
                    out.append((ids[slot], leaf, index[slot], subroot, root, proof, folded, folded == root))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    parts = [F.col(f"slots.{c}").alias(f"_{c}") for c in ("id", "index", "digest", "shown")]
    schema = (
        "id bigint, leaf string, index bigint, subroot string, root string, proof array<string>, folded_root string, verified boolean"
    )
    return joined.select(*parts, "nodes", "path", "subroot", "root").mapInArrow(prove, schema)


def manifest(leaves: DataFrame, arity: int = 2) -> DataFrame:
    """``id, leaf, index, subroot, root, proof, folded_root, verified`` of every row of ``group, id, leaf, shown``.

    ``leaf`` is the recorded digest, ``shown`` that of the record as it is now (NULL: the same), both as hex text.  ``proof`` lists
    the siblings from the leaf up to the root, left to right within a level; ``folded_root`` is what they give with ``shown``.
    """
    shape = Shape(arity)
    # A sign before the group's name keeps NULL apart from every name and before them.
    tree = F.when(F.col("group").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("group")))
    rows = written(
        leaves.select(
            tree.alias("tree"),
            F.col("id").cast("bigint").alias("id"),
            F.unhex("leaf").alias("leaf"),
            F.unhex("shown").alias("shown"),
        )
    )
    if rows.isEmpty():
        return leaves.sparkSession.createDataFrame(
            [],
            "id bigint, leaf string, index bigint, subroot string, root string, proof array<string>, folded_root string, verified boolean",
        )
    nodes, sizes = placed(rows)
    rounds, subroots = built(nodes.withColumnRenamed("leaf", "digest"), sizes, shape)
    # The tree over the groups, in the order of their names' bytes.
    groups = numbered(subroots, shared_path(leaves.sparkSession), "index", order=("tree",))
    groups = groups.select(F.lit("").alias("tree"), "index", "digest", F.col("tree").alias("group"))
    count = groups.groupBy("tree").agg(F.count("*").alias("n"))
    upper, roots = built(groups, count, shape)
    root = roots.first()["digest"].hex()
    above = leaves.sparkSession.createDataFrame([("", 0, "")], "tree string, index bigint, path string")
    for slots in reversed(upper):
        above = _descend(slots, above, shape)
    named = groups.select("index", "group", F.lower(F.hex("digest")).alias("subroot"))
    above = written(
        above.join(named, "index").select(
            F.col("group").alias("tree"), F.lit(0).cast("bigint").alias("index"), "path", "subroot", F.lit(root).alias("root")
        )
    )
    for slots in reversed(rounds[1:]):
        above = _descend(slots, above, shape)
    return _proved(rounds[0], above, shape)
