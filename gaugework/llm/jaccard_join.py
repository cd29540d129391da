"""Exact self-join of documents by the Jaccard distance of their word n-grams, as a metric-space join.

The distance ``1 - J`` is a metric, and so is its one-sided form ``|x - y|``.  Two documents link when their
distance is at most ``radius = 1 - threshold``.

Regions.  Against whole documents as pivots nearly every distance is 1, and then no triangle
inequality separates anything.  The first pivots are therefore sets of shingles: with all shingles in one fixed
order, pivot ``g`` is the set of ``g`` and all shingles after it.  A document's nearest pivot (at
one-sided distance 0) is that of its first shingle, which is its Voronoi region.  A document that links to one of
region ``g`` has at most ``radius * size`` shingles before ``g``, so it is replicated into the
regions of its first ``radius * size + 1`` shingles and no others: the window.  Every linking pair meets in
the region of its first common shingle, where the shingles before it add up to a bound on their distance.  The order is rare before frequent, by a count of all
documents' shingles in ``BUCKETS`` hash buckets (a table of fixed size), so a passage that many documents share
makes no region of its own unless it is most of a document.

Recursion.  In a region of more than two documents one of them becomes a pivot, and the distance of every member to it
is computed once.  Members within ``radius`` link to it.  After each round the components of all links found so
far are known; only two members of one component need not be compared with each other.  A region
is done once its members are of one component; else it recurses with ``GROWTH`` times as many new pivots,
taken from the smaller components first.  Members that link to a pivot leave the region if the triangle inequality
rules out every member of another component: their distance to the pivot is below the smallest of
such a member less ``radius``.  That needs the distances of all members, which is worth it for ``MEASURED`` pivots of a region; to
later ones only members of other components are compared, and only if the bitmaps (see below) leave a link possible.  So are
the members of regions of at most ``SMALL`` pairs, all of them at once.  Nothing is capped; a region costs its size
times the number of pivots it needs, and the rounds grow with the logarithm of that.

Every set also has a parity bitmap of about two bits a shingle.  Bits in which two bitmaps differ are shingles in
which the sets differ, so they bound the distance from below, which rules out nearly all pairs that
do not link; only for the others do whole sets travel.

All of a document's copies (equal sets) are one node.  Every round is written out, so lost executors
cost no more than a round.

Defined cases: a NULL or empty text has no shingles and links to nothing; a text of fewer words than ``n`` is one shingle of them all;
repeated rows are copies; rows that repeat an id are one document, which links to whatever one of its
texts links to; rows without id keep a NULL component unless an equal text has an id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.components import components
from gaugework.llm.shared import bounded_batches, mix, slices, strings, written

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
BLOCKS = 64
#: Pairs (members outside the largest component times members) up to which a region is compared pair by pair.
SMALL = 1 << 14
#: By how much the number of pivots in a region grows each round.
GROWTH = 16
#: Rounds of up to so many pivots in a region measure the distances of all its members.
MEASURED = 16
#: Ids of documents whose sets are wanted are first looked up in a broadcast table of at most so many
#: numbers (4 bytes each).
FILTER_BITS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Shingles of ``n`` words link at ``whole * common >= part * union``."""

    n: int = 5
    part: int = 80
    whole: int = 100

    def window(self, size: int) -> int:
        """How many of its first shingles a set of ``size`` is replicated to."""
        if self.whole * size < self.part * (size + 1):
            return 0  # smaller sets link to equal ones only
        return size + (-self.part * size // self.whole) + 1

    def links(self, common: Column, a: Column, b: Column) -> Column:
        return self.whole * common >= self.part * (a + b - common)

    def near(self, differing: Column, a: Column, b: Column) -> Column:
        """Whether sets of sizes ``a`` and ``b`` can link that differ in at least so many shingles."""
        return (a + b - differing) * self.whole >= (a + b + differing) * self.part


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, ends)``: the sorted different shingles of every text in a row, and where each text ends."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = words.flatten()
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0)
    kept = real.to_numpy(zero_copy_only=False)
    if not kept.all():
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        flat = flat.filter(real)
    index = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    distinct = np.array([digest(w) for w in index.dictionary.to_pylist()], np.uint64)
    hashed = distinct[index.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.uint64)
    counts = np.diff(offsets)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(hashed) - n + 1, 0), np.uint64)
        for i in range(n):
            rolled = rolled * _STEP + hashed[i : i + len(rolled)]
        rolled = mix(rolled)
        out, ends, total = [], np.empty(len(counts), np.int64), 0
        for d, (start, count) in enumerate(zip(offsets[:-1].tolist(), counts.tolist(), strict=True)):
            if count >= n:
                own = np.sort(rolled[start : start + count - n + 1])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif count:
                whole = np.uint64(count)
                for w in hashed[start : start + count]:
                    whole = whole * _STEP + w
                own = mix(np.array([whole]))
            else:
                own = rolled[:0]
            out.append(own)
            total += len(own)
            ends[d] = total
    return np.concatenate([np.zeros(0, np.uint64), *out]), ends


def _each_slice(batches: Iterator[pa.RecordBatch], n: int):
    for batch in batches:
        texts = strings(batch.column(1))
        for at, many in slices(texts):
            hashes, ends = shingle_sets(texts.slice(at, many), n)
            # Workers are used again by later stages; what a slice took is given back before the next.
            pa.default_memory_pool().release_unused()
            yield batch.column(0).slice(at, many), hashes, ends


def tally(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """How many of the ``hashes`` of all ``rows`` fall into each hash bucket, scaled to at most 20 bits.

    A task sends its counters as ``BLOCKS`` rows; whoever receives a block only keeps its sum.
    """
    width = BUCKETS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, "<u4")
        for own in hashes(batches):
            held += np.bincount((own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS).astype("<u4")
        parts = [held[b * width : (b + 1) * width].tobytes() for b in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "held"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(held.as_buffer(), "<u4")
                sums[block] = sums[block] + own if block in sums else own.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                names=["block", "held"],
            )

    shape = "block int, held binary"
    parts = rows.mapInArrow(count, shape)
    sums = parts.repartition("block").mapInArrow(add, shape)
    counted = np.zeros(BUCKETS, np.int64)
    for block, held in sums.collect():  # BUCKETS numbers
        counted[block * width : (block + 1) * width] = np.frombuffer(bytes(held), np.int64)
    step = max(1, int(counted.sum()) // (BUCKETS * 64))
    return np.minimum(counted // step, (1 << 20) - 1).astype(np.uint32)


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """The :func:`tally` of the shingles of all documents."""
    return tally(docs.select("doc_id", "text"), lambda batches: (hashes for _, hashes, _ in _each_slice(batches, n)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _parity(hashes: np.ndarray) -> np.ndarray:
    """A bit per residue of the hashes modulo a power of two: whether an odd number of them has it."""
    width = 64
    while width < len(hashes):
        width *= 2
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, size, key, window, bits``: a set's size, digest, parity bitmap and the shingles whose regions it enters."""
    order = docs.sparkSession.sparkContext.broadcast(frequencies(docs, rule.n))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, ends in _each_slice(batches, rule.n):
            # Rare first; equal ranks keep the order of the hashes.
            rank = order.value[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(44)
            rank |= hashes >> np.uint64(20)
            keys, windows, bitmaps, sizes, start = [], [], [], [], 0
            for end in ends.tolist():
                own = hashes[start:end]
                width = rule.window(end - start)
                first = np.argsort(rank[start:end], kind="stable")[:width]
                windows.append(own[first].view(np.int64))
                bitmaps.append(_parity(own))
                keys.append(blake2b(own.tobytes(), digest_size=16).digest() if end > start else None)
                sizes.append(end - start)
                start = end
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(windows), _lists(bitmaps)],
                names=["doc_id", "size", "key", "window", "bits"],
            )

    schema = "doc_id bigint, size bigint, key binary, window array<bigint>, bits array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(sketch, schema)


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``node, shingles`` of the documents in ``nodes``.

    Most other documents are left out before anything is shuffled, by a bit table of fixed size.
    """
    bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).cast("int").alias("_bit")
    bits = nodes.select(bit).distinct()  # FILTER_BITS numbers at most
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), "text")
    near = named.withColumn("_bit", bit).join(F.broadcast(bits), "_bit", "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, ends in _each_slice(batches, n):
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["node", "shingles"])

    wanted = near.join(nodes, "node", "left_semi").select("node", "text")
    return wanted.mapInArrow(shingle, "node bigint, shingles array<bigint>")


def _differing_bits(a: str, b: str) -> Column:
    """Bits in which two parity bitmaps differ; the longer one is folded to the length of the other."""
    length = F.least(F.size(a), F.size(b))

    def folded(bits: str) -> Column:
        # Sizes of linking sets are close, so one fold is enough; a longer bitmap loses no bound by less.
        half = F.zip_with(F.slice(bits, F.lit(1), length), F.slice(bits, length + 1, length), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) == 2 * length, half).otherwise(F.col(bits))

    bits = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    total = F.aggregate(bits, F.lit(0), lambda n, x: n + x)
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * length, total).otherwise(0).cast("bigint")


def _looked_up(rows: DataFrame, by: str, nodes: DataFrame, **names: str) -> DataFrame:
    """``rows`` with columns of ``nodes`` for the node in ``by``, under new ``names``.

    They are renamed after the join: so Spark shuffles ``nodes`` once for all the columns they are looked up by.
    """
    found = rows.alias("_rows").join(nodes.alias("_nodes"), F.col(f"_rows.{by}") == F.col("_nodes.node"))
    return found.select("_rows.*", *(F.col(f"_nodes.{c}").alias(name) for c, name in names.items()))


def measured(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule, repeated: bool = True) -> DataFrame:
    """``pivot, node, linked, distance`` of all ``pairs`` (``pivot, node``, none twice).

    The distance is exact where the bitmaps leave a link possible, else a lower bound above the radius.  ``repeated`` says
    whether ids may have several texts.
    """
    both = _looked_up(pairs, "node", nodes, size="_a", bits="_ours")
    both = _looked_up(both, "pivot", nodes, size="_b", bits="_theirs")
    total = F.col("_a") + F.col("_b")
    apart = F.greatest(_differing_bits("_ours", "_theirs"), F.abs(F.col("_a") - F.col("_b")))
    # At least so many shingles are in one set only; the similarity is at most this fraction.
    bounded = both.withColumn("_apart", apart).select(
        "pivot",
        "node",
        rule.near(F.col("_apart"), F.col("_a"), F.col("_b")).alias("_may"),
        (1 - (total - F.col("_apart")) / (total + F.col("_apart"))).alias("distance"),
    )
    if repeated:
        bounded = bounded.groupBy("pivot", "node").agg(F.max("_may").alias("_may"), F.min("distance").alias("distance"))
    bounded = written(bounded)
    may = bounded.where("_may").select("pivot", "node")
    wanted = may.select("node").unionByName(may.select(F.col("pivot").alias("node"))).distinct()
    sets = written(sets_of(docs, wanted, rule.n))
    compared = _looked_up(_looked_up(may, "node", sets, shingles="_ours"), "pivot", sets, shingles="_theirs")
    sized = compared.select(
        "pivot",
        "node",
        F.size(F.array_intersect("_ours", "_theirs")).cast("bigint").alias("_common"),
        F.size("_ours").cast("bigint").alias("_a"),
        F.size("_theirs").cast("bigint").alias("_b"),
    )
    linked = rule.links(F.col("_common"), F.col("_a"), F.col("_b"))
    distance = 1 - F.col("_common") / (F.col("_a") + F.col("_b") - F.col("_common"))
    exact = sized.select("pivot", "node", linked.alias("linked"), distance.alias("distance"))
    # An id with several rows counts with the nearest of its texts.
    exact = exact.groupBy("pivot", "node").agg(F.max("linked").alias("linked"), F.min("distance").alias("distance"))
    never = bounded.where(~F.col("_may")).select("pivot", "node", F.lit(False).alias("linked"), "distance")
    return written(never.unionByName(exact))


def _regions(nodes: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of the regions with two nodes, the members of those with more, and all nodes of either.

    Members are ``g, node, depth, size, shares``; ``depth`` is the one-sided distance to the region's pivot, the
    number of a set's shingles before ``g``.  Members too deep to link to any other with ``g`` as the first common
    shingle are left out: in a large table that is most of what meets by chance.
    """
    # Most of what enters is alone in its region.  It is shuffled once, for the counts and for the join with them; the
    # counts take all columns, since with fewer Spark would make another shuffle of them.
    entered = nodes.select(F.posexplode("window").alias("depth", "g"), "node", "size").repartition("g")
    after = F.col("size") - F.col("depth")
    counts = entered.groupBy("g").agg(
        F.count("*").alias("n"),
        F.min("node").alias("least"),
        F.max("node").alias("other"),
        F.bit_xor(F.xxhash64("node")).alias("mark"),
        F.sum("depth").alias("depths"),
        F.min("depth").alias("_depth"),
        F.max("size").alias("_size"),
        (F.sum("depth") + F.max(after) - F.min(after)).alias("_between"),
        F.sum("size").alias("_sizes"),
    )
    shared = counts.where(F.col("least") != F.col("other"))
    # Of two members both depths are known, else the least of the others' and the size of the largest that can link.
    two, largest = F.col("n") == 2, F.floor(F.col("size") * rule.whole / rule.part)
    apart = F.when(two, F.col("_between")).otherwise(F.col("depth") + F.col("_depth"))
    total = F.when(two, F.col("_sizes")).otherwise(F.col("size") + F.least("_size", largest))
    met = entered.join(shared, "g").where(rule.near(apart, total, F.lit(0)))
    marks = ["n", "least", "other", "mark"]
    members = written(met.select("g", *marks, "depths", "node", "depth", "size"))
    # Copies share many shingles: of regions with the same nodes, those left out included, the first in the order is enough.
    one = written(members.groupBy(*marks).agg(F.min_by("g", "depths").alias("g")))
    two = one.where("n = 2")
    more = members.where("n > 2").join(one.where("n > 2").select("g"), "g", "left_semi")
    # A node that shares much of its window is near the centre of its copies: a good pivot.
    shares = written(members.groupBy("node").agg(F.count("*").alias("shares")))
    more = more.groupBy("g", "node").agg(F.min("depth").alias("depth"), F.max("size").alias("size"))
    more = more.join(shares, "node")
    return two.select(F.col("least").alias("pivot"), F.col("other").alias("node")), more, shares.select("node")


def links(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: links that connect exactly the nodes that all linking pairs connect.

    ``nodes`` holds ``node, size, window, bits, several``, ``docs`` the texts by ``doc_id``.  Nodes are ``several`` if
    their id has several texts; the triangle inequality does not hold for those.
    """
    pairs, members, meeting = _regions(nodes, rule)
    several = written(nodes.where("several").select("node").distinct())
    repeated = not several.isEmpty()
    # Only nodes that meet another one are ever compared.
    nodes = written(nodes.select("node", "size", "bits").join(meeting, "node", "left_semi"))
    radius = 1 - rule.part / rule.whole
    # ``peers`` counts the region's members of the same component; a link has a member that is ``open``.
    alone = {"component": F.col("node"), "peers": F.lit(1).cast("bigint"), "open": F.lit(True)}
    inside = written(members.withColumns(alone))
    found, known, count = None, None, 1
    while True:
        # The most central members of the smallest components become pivots; ranking keeps few rows of a region before the shuffle.
        rank = F.row_number().over(Window.partitionBy("g").orderBy("peers", F.desc("shares"), "node"))
        pivots = written(_as_pivots(inside.where("open").withColumn("_rank", rank).where(F.col("_rank") <= count)))
        if count <= MEASURED:
            reached = _together(inside, pivots.drop("_component"), rule)
        else:
            reached = _apart(inside, pivots, nodes, rule)
        wanted = pairs.unionByName(
            reached.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node"))
        )
        tested = measured(wanted.distinct(), nodes, docs, rule, repeated)
        linked = tested.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        found = linked if found is None else found.unionByName(linked)
        if inside.isEmpty():
            return found
        if known is None or not linked.isEmpty():
            known = written(components(found))
        found = known.select(F.col("node").alias("a"), F.col("component_id").alias("b"))
        rest = (
            inside.drop("component", "peers", "open")
            .join(pivots.select("g", F.col("pivot").alias("node")), ["g", "node"], "left_anti")
            .join(known, "node", "left")
            .withColumn("component", F.coalesce("component_id", "node"))
            .drop("component_id")
        )
        # Counting reads its members three times, so they are written before.
        rest = written(_unconnected(written(rest)))
        kept = rest.drop("peers", "open", "_open", "_all")
        if count <= MEASURED:
            outside = written(_outside(rest, reached, tested, known, several, radius))
            kept = written(kept.join(outside, ["g", "node"], "left_anti"))
        few = (F.col("_open") * F.col("_all") <= SMALL).alias("small")
        left = written(_unconnected(kept).select(*inside.columns, few))
        if left.isEmpty():
            return found
        small = left.where("small").drop("small")
        each = _apart(small, _as_pivots(small.where("open")), nodes, rule)
        pairs = each.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")).distinct()
        inside = left.where(~F.col("small")).drop("small")
        count *= GROWTH


def _as_pivots(members: DataFrame) -> DataFrame:
    """``members`` with the column names of the other side of a pair."""
    names = {"node": "pivot", "depth": "_depth", "size": "_size", "component": "_component"}
    return members.select("g", *(F.col(c).alias(name) for c, name in names.items()))


def _outside(
    rest: DataFrame, reached: DataFrame, tested: DataFrame, known: DataFrame, several: DataFrame, radius: float
) -> DataFrame:
    """``g, node`` of the members that link to a pivot and can link to no member of another component.

    The triangle inequality: what links to a member of another component is at least as far from the pivot as that member, less ``radius``.
    It needs the distance of every such member.
    """
    both = tested.unionByName(tested.select(F.col("node").alias("pivot"), F.col("pivot").alias("node"), "linked", "distance"))
    seen = (
        reached.select("g", "pivot", "node")
        .join(rest.select("g", "node", "component", "peers", "_all"), ["g", "node"])
        .join(both, ["pivot", "node"])
        .join(known.select(F.col("node").alias("pivot"), F.col("component_id").alias("_component")), "pivot", "left")
        .withColumn("_other", F.col("component") != F.coalesce("_component", "pivot"))
    )
    # A pivot's linked members are of its component and say how many there are of it.
    nearest = seen.groupBy("g", "pivot").agg(
        F.min(F.when(F.col("_other"), F.col("distance"))).alias("_nearest"),
        F.count_if("_other").alias("_seen"),
        F.max(F.when(~F.col("_other"), F.col("_all") - F.col("peers"))).alias("_others"),
    )
    nearest = nearest.where(F.col("_seen") == F.col("_others"))
    outside = (
        seen.where("linked")
        .join(nearest, ["g", "pivot"])
        .where(F.col("distance") < F.col("_nearest") - radius - 1e-9)
        .join(several, "node", "left_anti")
        .join(several.withColumnRenamed("node", "pivot"), "pivot", "left_anti")
    )
    return outside.select("g", "node").distinct()


def _unconnected(members: DataFrame) -> DataFrame:
    """Members of the regions with more than one component: how many ``peers`` are of a member's own, whether it is
    ``open`` (not of the region's largest one), and how many members are ``_open`` and in ``_all``."""
    own = members.groupBy("g", "component").agg(F.count("*").alias("peers"))
    largest = F.max(F.struct("peers", "component"))
    regions = own.groupBy("g").agg(F.sum("peers").alias("_all"), largest.alias("_largest"))
    regions = regions.withColumn("_open", F.col("_all") - F.col("_largest.peers")).where(F.col("_open") > 0)
    sized = members.join(regions, "g").join(own, ["g", "component"])
    return sized.withColumn("open", F.col("component") != F.col("_largest.component")).drop("_largest")


def _together(members: DataFrame, pivots: DataFrame, rule: Rule) -> DataFrame:
    """Members of each region beside its pivots, where a link can have ``g`` as the first common shingle.

    The shingles of either set before ``g`` are then in one set only, so their depths add up.
    """
    both = F.col("depth") + F.col("_depth")
    return members.join(pivots, "g").where(
        (F.col("node") != F.col("pivot")) & rule.near(both, F.col("size"), F.col("_size"))
    ).drop("_depth", "_size")


def _apart(members: DataFrame, pivots: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Those of :func:`_together` that are of other components (``component``, ``_component``) and whose bitmaps leave a link possible.

    All of it is one condition of the join, so what it rules out is never a row.
    """
    ours = _looked_up(members, "node", nodes, size="_a", bits="_ours")
    theirs = _looked_up(pivots, "pivot", nodes, size="_b", bits="_theirs")
    differing = _differing_bits("_ours", "_theirs")
    return (
        _together(ours, theirs, rule)
        .where((F.col("component") != F.col("_component")) & rule.near(differing, F.col("_a"), F.col("_b")))
        .select("g", "pivot", "node")
    )


def near_duplicates(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest id that links reach, the document's own included.
    """
    rule = rule or Rule()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = written(sketches(docs, rule))
    nodes = written(
        rows.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("node"),
            F.first("size").alias("size"),
            F.first("window").alias("window"),
            F.first("bits").alias("bits"),
        )
    )
    texts = rows.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull()).groupBy("doc_id")
    several = texts.agg(F.min("key").alias("_first"), F.max("key").alias("_last")).where("_first != _last")
    several = written(several.select("doc_id"))
    marked = several.select(F.col("doc_id").alias("node"), F.lit(True).alias("several"))
    named = nodes.where(F.col("node").isNotNull() & (F.size("window") > 0)).join(marked, "node", "left")
    named = named.select("node", "size", "window", "bits", F.coalesce("several", F.lit(False)).alias("several"))
    linked = links(docs, named, rule)
    # An id with several texts connects the classes of all of them.
    same = (
        rows.join(several, "doc_id", "left_semi")
        .join(nodes.select("key", "node"), "key")
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    )
    found = components(linked.unionByName(same))
    named = nodes.select("key", "node").join(found, "node", "left")
    named = named.select("key", F.coalesce("component_id", "node").alias("_component"))
    joined = rows.select("doc_id", "size", "key").join(named, "key", "left")
    return joined.select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id")
    )
