"""Exact k nearest binary codes by multi-index hashing with growing segment radii.

A 64-bit code is cut into segments of about log2(number of codes) bits.  The search radius of one segment
after the other grows by a bit: its index is asked for the values that differ from the query's in
exactly so many bits.  A code that differs in every segment by more than that segment's radius
is farther than the sum of (radius + 1) over the segments less one, so every nearer code has been seen.
A query leaves once its k-th verified distance is covered; the result is exact, ties included.

Every query knows a distance within which enough codes lie: at first by a comparison with ``SEEDS`` codes, later by what was
found.  The lookup itself leaves out codes beyond it, so they never become rows.

Equal codes are searched once, on both sides: a code stands for the ``k + 1`` smallest ids that
hold it (one of which may be the query's own).  Ranking keeps k + 1 rows per code already
before the shuffle, so a code that a third of the rows share stays small.

Defined cases: vectors that are NULL or hold NULL or non-finite components, and NULL ids, take no part; an empty
vector has the code 0; repeated rows count once; ties go to the smaller id; with fewer
than k candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.shared import saved

BITS = 64
WIDEST = 24
#: Masks that one round looks up, at least.
TOGETHER = 500
#: Codes (those with the smallest hash) that give each query its first bound; 32 KB.
SEEDS = 4096


def sign_code(vector: str) -> Column:
    """Bit ``i mod 64`` is flipped by every positive component ``i``; NULL for unusable vectors."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def flip(code: Column, bit: Column) -> Column:
        return code.bitwiseXOR(F.call_function("shiftleft", bit["on"].cast("bigint"), bit["at"]))

    bits = F.transform(
        vector, lambda x, i: F.struct((x > 0).cast("int").alias("on"), (i % BITS).cast("int").alias("at"))
    )
    return F.when(usable, F.aggregate(bits, F.lit(0).cast("bigint"), flip))


def _segments(n: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of segments of nearly equal width, at most log2(n).

    Wider segments would be asked for more values than there are codes.
    """
    count = max(math.ceil(BITS / WIDEST), min(BITS // 4, math.ceil(BITS / math.log2(max(n, 2)))))
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _rounds(segments: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """``(segment, radius)`` in the order of search: one segment's radius grows at a time.

    Steps with few masks are taken together, ``TOGETHER`` masks a round.
    """
    group, masks = [], 0
    for radius in range(max(w for _, w in segments) + 1):
        for i, (_, width) in enumerate(segments):
            if radius <= width:
                group.append((i, radius))
                masks += math.comb(width, radius)
                if masks >= TOGETHER:
                    yield group
                    group, masks = [], 0
    if group:
        yield group


def _by_segment(codes: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """Every row of ``codes`` once a segment, with the ``segment`` and its ``value`` in ``code``."""
    parts = [
        F.struct(
            F.lit(i).alias("segment"),
            F.shiftrightunsigned("code", shift).bitwiseAND((1 << width) - 1).alias("value"),
        )
        for i, (shift, width) in enumerate(segments)
    ]
    return codes.select("*", F.inline(F.array(*parts)))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bounded(wanted: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """``wanted`` with ``far``: at least ``k + 1`` codes are as near, as ``SEEDS`` of them show."""
    seeds = distinct.orderBy(F.xxhash64("code"), "code").limit(SEEDS).agg(F.collect_list("code").alias("_seeds"))
    near = F.sort_array(F.transform("_seeds", lambda c: F.bit_count(c.bitwiseXOR(F.col("code")))))
    # One row of SEEDS codes beside every query.
    beside = wanted.join(F.broadcast(seeds))
    return beside.select("code", F.when(F.size("_seeds") > k, F.get(near, F.lit(k))).otherwise(BITS).alias("far"))


def _masks(width: int, radii: list[int]) -> Column:
    """All masks of ``width`` bits with as many ones as one of ``radii``, as one constant array."""
    masks = (sum(1 << b for b in bits) for r in radii for bits in combinations(range(width), r))
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")


def _smallest(rows: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, id, distance`` of the k nearest codes of every query but its own id.

    Both frames hold ``id, code``.
    """
    rows = codes.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code").distinct()
    members = saved(_smallest(rows, "code", k + 1, "id"))
    distinct = saved(members.select("code").distinct())
    asked = queries.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code").distinct()
    n = distinct.count()
    segments = _segments(n)
    index = saved(_by_segment(distinct, segments))
    wanted = saved(_bounded(asked.select("code").distinct(), distinct, k))
    kept, done = None, None
    reach = [-1] * len(segments)
    for steps in _rounds(segments):
        probe = None
        for i, (_, width) in enumerate(segments):
            radii = [r for at, r in steps if at == i]
            if radii:
                reach[i] = max(radii)
                near = F.transform(_masks(width, radii), lambda m: m.bitwiseXOR(F.col("value")))
                own = _by_segment(wanted, segments).where(F.col("segment") == i).withColumn("value", F.explode(near))
                probe = own if probe is None else probe.unionByName(own)
        held = index.withColumnRenamed("code", "held").alias("i")
        # One condition of the join, so what lies beyond the bound is never a row.
        within = _apart("code", "held") <= F.col("far")
        same = (F.col("p.segment") == F.col("i.segment")) & (F.col("p.value") == F.col("i.value"))
        pairs = probe.alias("p").join(held, same & within).select(F.col("code").alias("query"), F.col("held").alias("code"))
        found = pairs.distinct().join(members, "code").select("query", _apart("query", "code").alias("distance"), "id")
        if kept is not None:
            found = found.unionByName(kept.join(wanted.select(F.col("code").alias("query")), "query", "left_semi"))
        best = saved(_smallest(found.distinct(), "query", k + 1, "distance", "id"))
        # A code that differs by more than reach[i] bits in every segment i is farther than this.
        covered = sum(r + 1 for r in reach) - 1
        full = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        finished = full.where((F.col("n") > k) & (F.col("far") <= covered)).select("query")
        last = all(r == w for r, (_, w) in zip(reach, segments, strict=True))
        leaving = best if last else best.join(finished, "query", "left_semi")
        done = leaving if done is None else done.unionByName(leaving)
        if last:
            break
        kept = best
        nearer = full.where(F.col("n") > k).select(F.col("query").alias("code"), F.col("far").alias("_far"))
        left = wanted.join(finished.select(F.col("query").alias("code")), "code", "left_anti").join(nearer, "code", "left")
        wanted = saved(left.select("code", F.least("far", F.coalesce("_far", "far")).alias("far")))
        if wanted.isEmpty():
            break
    nearest = done.groupBy(F.col("query").alias("code")).agg(
        F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("nearest")
    )
    own = asked.withColumnRenamed("id", "query_id").join(nearest, "code")
    others = F.slice(F.filter("nearest", lambda x: x["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("_at", "_hit")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.id").alias("id"), F.col("_hit.distance").alias("distance")
    )
