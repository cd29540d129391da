"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on whole shingle sets.

A signature has ``POSITIONS`` symbols of 8 bits, each of the shingle that is first under a hash function of its own.  Sets of
similarity ``J`` differ in about ``(1 - J) * POSITIONS`` symbols; ``ERRORS`` lies 4.3 standard deviations above that for the
threshold of 0.8, so of 100,000 linked pairs just at the threshold about one is farther (other thresholds need other numbers).

Multi-index.  Signatures are cut into chunks of which each may hold ``PER_CHUNK`` errors, so many that a pair with at most
``ERRORS`` errors has at least one chunk within its allowance.  A chunk's errors are enumerated by masking every choice of
``PER_CHUNK`` symbols; chunk, mask and the symbols left are a key.  Every pair within ``ERRORS`` shares a key.

Links without all pairs.  The most central node of a key (that shares most keys with most others) is its pivot; the nodes that share a key
with a pivot are its region.

1. Every node is compared with the nearest of its pivots, then with those of its pivots that are not in its component yet.
2. Regions whose nodes are of one component are done: near copies of one text cost their number, not its square.
3. Elsewhere, regions whose pivots are of one component are taken together, and nodes outside the region's largest component
   are compared with those of other components: in regions of at
   most ``SMALL`` such pairs directly, in others where they share one of their rarest shingles.  Two sets that link have
   one in common among so many of their first shingles in any order that all the others together are too
   few; the order is first what the region's pivot lacks, rare before frequent by a count in ``BUCKETS`` hash buckets (a table
   of fixed size) over all such regions, so what sets a node apart is looked up first.

Pairs are ruled out by the sizes, by the signatures' distance and by parity bitmaps (a bound of the sets' difference), and only what is
left is compared shingle by shingle.  Copies (equal sets) are one node.  Every step is written out.

Defined cases: a NULL or empty text has no shingles and links to nothing; a text of fewer words than ``n`` is one shingle of
them all; repeated rows are copies; rows that repeat an id are one document, which links to whatever one of its texts links to;
rows without id keep a NULL component unless an equal text has an id; an empty table gives no rows; other columns are
ignored.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.components import components
from gaugework.llm.jaccard_join import BUCKET_BITS, Rule, sets_of, shingle_sets, tally
from gaugework.llm.shared import extended, mix, slices, strings, written

POSITIONS = 128
ERRORS = 45
PER_CHUNK = 1
#: Pairs up to which a region is compared directly.
SMALL = 4096
_SEED = 20_240_131


def chunks(positions: int = POSITIONS, errors: int = ERRORS, per_chunk: int = PER_CHUNK) -> list[np.ndarray]:
    """Positions of each chunk; if every chunk had more than ``per_chunk`` errors, there were more than ``errors``."""
    count = errors // (per_chunk + 1) + 1
    if count * (per_chunk + 1) > positions:
        raise ValueError("a chunk must be longer than the errors it allows")
    return np.array_split(np.arange(positions), count)


def signatures(hashes: np.ndarray, ends: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """The symbols of every set, one row each; the sets must not be empty."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(1 << 31, 1 << 32, positions, dtype=np.uint32) | np.uint32(1)
    offsets = rng.integers(0, 1 << 32, positions, dtype=np.uint32)
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    out = np.empty((len(ends), positions), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(positions):
            least = np.minimum.reduceat(x * factors[k] + offsets[k], starts)
            out[:, k] = (mix(least.astype(np.uint64) + (np.uint64(k) << np.uint64(32))) >> np.uint64(56)).astype(np.uint8)
    return out


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values))


def _parity(hashes: np.ndarray) -> np.ndarray:
    """About four bits per shingle: whether an odd number of the hashes has a residue."""
    width = 64
    while width < 4 * len(hashes):
        width *= 2
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, size, key, signature, bits`` of every row; NULL key, signature and bits for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for at, many in slices(texts):
                hashes, ends = shingle_sets(texts.slice(at, many), rule.n)
                sizes = np.diff(np.concatenate(([0], ends)))
                some = np.flatnonzero(sizes)
                signed = signatures(hashes, ends[some]) if len(some) else np.zeros((0, POSITIONS), np.uint8)
                symbols, bits, keys = [np.zeros(0, np.int64)] * many, [np.zeros(0, np.int64)] * many, [None] * many
                for row, i in enumerate(some.tolist()):
                    own = hashes[ends[i] - sizes[i] : ends[i]]
                    symbols[i] = signed[row].view(np.int64)
                    bits[i] = _parity(own)
                    keys[i] = blake2b(own.tobytes(), digest_size=16).digest()
                columns = [
                    batch.column(0).slice(at, many),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(keys, pa.binary()),
                    *(_lists(np.concatenate(v), np.cumsum([len(a) for a in v])) for v in (symbols, bits)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "key", "signature", "bits"])

    schema = "doc_id bigint, size bigint, key binary, signature array<bigint>, bits array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(sketch, schema)


def masked_keys(nodes: DataFrame, errors: int = ERRORS, per_chunk: int = PER_CHUNK) -> DataFrame:
    """``key, node``: every chunk of every signature under every mask of ``per_chunk`` symbols."""
    parts = chunks(POSITIONS, errors, per_chunk)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = mix(np.arange(POSITIONS * 256, dtype=np.uint64) + np.uint64(1 << 40)).reshape(POSITIONS, 256)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ids = batch.column(0).slice(at, 2048)
                symbols = batch.column(1).slice(at, 2048).flatten().to_numpy().view(np.uint8).reshape(len(ids), POSITIONS)
                own = table[np.arange(POSITIONS), symbols]
                keys = []
                for part in parts:
                    whole = own[:, part].sum(1, dtype=np.uint64)
                    for mask in combinations(part.tolist(), per_chunk):
                        salt = np.uint64(sum((p + 1) << (16 * i) for i, p in enumerate((int(part[0]), *mask))) % (1 << 64))
                        keys.append(mix(whole - own[:, list(mask)].sum(1, dtype=np.uint64) + salt))
                repeated = np.tile(np.arange(len(ids)), len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), ids.take(pa.array(repeated))], names=["key", "node"]
                )

    return nodes.select("node", "signature").mapInArrow(index, "key bigint, node bigint")


def differing_symbols(a: str, b: str) -> Column:
    """In how many symbols two signatures differ: bytes that are not zero in the XOR."""

    def count(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(0x0101010101010101))

    return F.aggregate(F.zip_with(a, b, count), F.lit(0), lambda n, x: n + x)


def differing_bits(a: str, b: str) -> Column:
    """Bits in which parity bitmaps of one length differ; 0, which bounds nothing, for others."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.when(F.size(a) == F.size(b), bits).otherwise(0)


def _regions(nodes: DataFrame) -> DataFrame:
    """``pivot, node``: the nodes that share a key, beside the most central of them.

    A node that shares many keys with many others is near the centre of its family; taken as pivots, such nodes
    link to most of their regions and leave few regions to a family.
    """
    keys = masked_keys(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("_a"), F.max("node").alias("_b"))
    members = written(keys.join(shared.where("_a < _b").select("key", "n"), "key"))
    centrality = members.groupBy("node").agg(F.sum("n").alias("centrality"))
    ranked = members.select("key", "node").join(centrality, "node")
    pivots = ranked.groupBy("key").agg(F.max_by("node", F.struct("centrality", "node")).alias("pivot"))
    pairs = members.select("key", "node").join(pivots, "key").where("pivot != node")
    return written(pairs.select("pivot", "node").distinct())


def _sketched(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (``pivot, node``) with the sketch columns of both, marked ``_a`` and ``_b``."""
    ours = nodes.select("node", *(F.col(c).alias(f"{c}_a") for c in columns))
    theirs = nodes.select(F.col("node").alias("pivot"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(ours, "node").join(theirs, "pivot")


def _possible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """``pivot, node, distance`` of the pairs that sizes, signatures and bitmaps do not rule out."""
    both = _sketched(pairs, nodes, "size", "signature", "bits")
    apart = F.greatest(differing_bits("bits_a", "bits_b"), F.abs(F.col("size_a") - F.col("size_b")))
    both = both.where(rule.near(apart, F.col("size_a"), F.col("size_b")))
    both = both.withColumn("distance", differing_symbols("signature_a", "signature_b")).where(F.col("distance") <= ERRORS)
    return both.groupBy("pivot", "node").agg(F.min("distance").alias("distance"))


def _linked(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """``a, b`` of the ``pairs`` whose whole sets link."""
    wanted = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    sets = written(sets_of(docs, wanted, rule.n))
    both = pairs.join(sets.withColumnRenamed("shingles", "_ours"), "node").join(
        sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("_theirs")), "pivot"
    )
    common = F.size(F.array_intersect("_ours", "_theirs")).cast("bigint")
    linked = rule.links(common, F.size("_ours").cast("bigint"), F.size("_theirs").cast("bigint"))
    return written(both.where(linked).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())


def _with_component(rows: DataFrame, known: DataFrame, node: str, name: str) -> DataFrame:
    found = known.select(F.col("node").alias(node), F.col("component_id").alias(name))
    return rows.join(found, node, "left").withColumn(name, F.coalesce(name, node))


def _open(regions: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Members of the regions with more than one component; regions whose pivots are of one component are taken together.

    ``region, node, size, component, open, pairs, least``: ``region`` is the pivots' component, ``open`` are the members outside
    the region's largest component, ``pairs`` how many comparisons that makes at most, ``least`` the smallest set's size.
    """
    both = _with_component(regions, known, "pivot", "region")
    members = both.select("region", "node").unionByName(both.select("region", F.col("pivot").alias("node"))).distinct()
    members = _with_component(members, known, "node", "component").join(nodes.select("node", "size").distinct(), "node")
    own = members.groupBy("region", "component").agg(F.countDistinct("node").alias("n"), F.min("size").alias("least"))
    whole = own.groupBy("region").agg(
        F.sum("n").alias("_all"), F.min("least").alias("least"), F.max(F.struct("n", "component")).alias("_largest")
    )
    whole = whole.withColumn("pairs", (F.col("_all") - F.col("_largest.n")) * F.col("_all")).where(F.col("pairs") > 0)
    joined = members.join(whole, "region")
    return written(joined.withColumn("open", F.col("component") != F.col("_largest.component")).drop("_all", "_largest"))


def _beside(asked: DataFrame, members: DataFrame, keys: list[str], *conditions: Column) -> DataFrame:
    """``pivot, node``: an ``asked`` member and one of another component that agree in ``keys``."""
    other = asked.select(*keys, *(F.col(c).alias(f"{c}_b") for c in asked.columns if c not in keys))
    mine = members.select(*keys, *(F.col(c).alias(f"{c}_a") for c in members.columns if c not in keys))
    # One condition of the join, so what it rules out is never a row.
    agree = [F.col(f"m.{k}") == F.col(f"o.{k}") for k in keys]
    apart = F.col("component_a") != F.col("component_b")
    both = mine.alias("m").join(other.alias("o"), reduce(Column.__and__, [*agree, apart, *conditions]))
    ends = F.least("node_a", "node_b").alias("pivot"), F.greatest("node_a", "node_b").alias("node")
    return both.select(*ends).distinct()


def _values(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy()


def _rarest(members: DataFrame, docs: DataFrame, rule: Rule, several: DataFrame) -> DataFrame:
    """``members`` once for each of the shingles that a partner must have one of: ``shingle`` and its ``place``.

    Shingles that the node which names the region lacks come first, those of fewer members before others.  Members are
    counted by the hash bucket of a shingle, over all regions; only what a partner must have one of becomes a row.
    """
    pivots = members.select(F.col("region").alias("node"))
    sets = written(sets_of(docs, members.select("node").unionByName(pivots).distinct(), rule.n))
    both = members.join(sets.withColumnRenamed("shingles", "_ours"), "node").join(
        sets.select(F.col("node").alias("region"), F.col("shingles").alias("_theirs")), "region"
    )
    both = both.withColumn("_set", F.xxhash64("_ours")).withColumn("size", F.size("_ours").cast("bigint"))
    both = both.groupBy("region", "node", "_set").agg(
        *(F.first(c).alias(c) for c in members.columns if c not in ("region", "node", "size")),
        F.first("size").alias("size"),
        F.first("_ours").alias("_ours"),
        # One set for the whole region, if the node which names it has several texts.
        F.min("_theirs").alias("_theirs"),
    )
    both = written(
        both.withColumns(
            {"_own": F.array_except("_ours", "_theirs"), "_shared": F.sort_array(F.array_intersect("_ours", "_theirs"))}
        ).drop("_ours", "_theirs")
    )
    held = tally(both.select("_own"), lambda batches: (_values(batch.column(0)).view(np.uint64) for batch in batches))
    order = docs.sparkSession.sparkContext.broadcast(held)
    # An id with several texts may have smaller sets than its node says.
    loose = members.join(several, "node", "left_semi").select("region").distinct().withColumn("_loose", F.lit(True))
    joined = both.join(loose, "region", "left")
    smallest = F.ceil(F.col("size") * rule.part / rule.whole)
    least = F.when(F.col("_loose").isNotNull(), smallest).otherwise(F.greatest("least", smallest)).cast("bigint")
    part, both_parts = rule.part, rule.part + rule.whole
    needed = F.expr(f"({part} * (size + _least) + {both_parts - 1}) div {both_parts}")
    many = F.greatest(F.col("size") - needed + 1, F.lit(1)).cast("int")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                listed = []
                for own, shared, count in zip(rows["_own"], rows["_shared"], rows["_many"].to_pylist(), strict=True):
                    mine = own.values.to_numpy()
                    rank = order.value[(mine.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    listed.append(np.concatenate((mine[np.lexsort((mine, rank))], shared.values.to_numpy()))[:count])
                ends = [len(x) for x in listed]
                kept = rows.select(names).take(pa.array(np.repeat(np.arange(len(ends)), ends)))
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in ends])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(places), pa.array(np.concatenate(listed))], names=[*names, "place", "shingle"]
                )

    names = members.columns
    sized = joined.withColumn("_least", least).select(*names, "_own", "_shared", many.alias("_many"))
    return sized.mapInArrow(first, extended(members.select(*names), place="int", shingle="bigint"))


def links(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: links that connect exactly the nodes that all linking pairs within ``ERRORS`` connect.

    ``nodes`` holds ``node, size, signature, bits, several``, ``docs`` the texts by ``doc_id``.
    """
    regions = _regions(nodes)
    pairs = written(_possible(regions, nodes, rule))
    nearest = pairs.groupBy("node").agg(F.min_by("pivot", F.struct("distance", "pivot")).alias("pivot"))
    found = _linked(written(nearest), docs, rule)
    known = components(found)
    rest = _with_component(_with_component(pairs, known, "node", "_a"), known, "pivot", "_b").where("_a != _b")
    found = found.unionByName(_linked(written(rest.select("pivot", "node")), docs, rule))
    known = components(found)
    members = _open(regions, nodes, known)
    sketch = nodes.select("node", "signature", "bits")
    signed = members.join(sketch, "node")
    sizes = rule.near(F.abs(F.col("size_a") - F.col("size_b")), F.col("size_a"), F.col("size_b"))
    bitmaps = rule.near(differing_bits("bits_a", "bits_b"), F.col("size_a"), F.col("size_b"))
    near = bitmaps & (differing_symbols("signature_a", "signature_b") <= ERRORS)
    small = signed.where(F.col("pairs") <= SMALL).drop("pairs", "least")
    few = _beside(small.where("open"), small, ["region"], sizes, near)
    large = members.where(F.col("pairs") > SMALL)
    several = nodes.where("several").select("node").distinct()
    if not large.isEmpty():
        listed = written(_rarest(large, docs, rule, several)).join(sketch, "node")
        listed = listed.drop("pairs", "least")
        before = F.col("place_a") + F.col("place_b")
        placed = rule.near(before, F.col("size_a"), F.col("size_b"))
        few = few.unionByName(_beside(listed.where("open"), listed, ["region", "shingle"], placed, near))
    # Members have been compared with their pivots.
    done = regions.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node"))
    few = few.distinct().join(done, ["pivot", "node"], "left_anti")
    left = written(_possible(few, nodes, rule))
    return found.unionByName(_linked(left.select("pivot", "node"), docs, rule))


def near_duplicates(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest id that links reach, the document's own included; ``kept`` are the rows with that id.
    """
    rule = rule or Rule()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = written(sketches(docs, rule))
    nodes = written(
        rows.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("node"),
            F.first("size").alias("size"),
            F.first("signature").alias("signature"),
            F.first("bits").alias("bits"),
        )
    )
    texts = rows.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull()).groupBy("doc_id")
    several = texts.agg(F.min("key").alias("_first"), F.max("key").alias("_last")).where("_first != _last")
    several = written(several.select("doc_id"))
    marked = several.select(F.col("doc_id").alias("node"), F.lit(True).alias("several"))
    # Smaller sets link to equal ones only.
    larger = rule.whole * F.col("size") >= rule.part * (F.col("size") + 1)
    named = nodes.where(F.col("node").isNotNull() & larger).join(marked, "node", "left")
    named = named.select("node", "size", "signature", "bits", F.coalesce("several", F.lit(False)).alias("several"))
    linked = links(docs, written(named), rule)
    # An id with several texts connects the classes of all of them.
    same = (
        rows.join(several, "doc_id", "left_semi")
        .join(nodes.select("key", "node"), "key")
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    )
    found = components(linked.unionByName(same))
    classes = nodes.select("key", "node").join(found, "node", "left")
    classes = classes.select("key", F.coalesce("component_id", "node").alias("_component"))
    joined = rows.select("doc_id", "size", "key").join(classes, "key", "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
