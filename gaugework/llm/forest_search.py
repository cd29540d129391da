"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a sample of different vectors (those with the smallest hash; ``SAMPLE`` rows, or more as long as
they fit into ``SAMPLE_BYTES``, so that leaves stay small as the table grows): every
node projects on the difference of two random sample points below it and splits at the
median.  All vectors are then sent down all trees.  A query walks the trees through one shared
priority queue, ordered by the smallest margin on the way, and collects leaves until they hold
``reach`` vectors; all vectors of those leaves are ranked by their exact distance.

The index is dealt into blocks of at most ``BLOCK_BYTES``.  A query comes to every block with its vector and its leaves; there the
vectors of those leaves are looked up, each is measured once, and only the ``k + 1`` nearest leave the task.  Pairs of a query and a
candidate, whose number grows with that of the queries times the reach, are never rows.

The reach follows from the table: the nearest vectors of ``TRIALS`` queries (those with the smallest hash) are found by brute force over
all vectors, and the reach is the least that finds the share ``RECALL`` of them, ``REACH`` at least.

The forest has a bounded size (trees times sample / leaf planes) and is broadcast; the index is a table of all
vectors with their leaf numbers.  Equal vectors are
indexed and searched once and stand for the ``k + 1`` smallest ids that hold them, which ranking cuts
before the shuffle, so a vector that a third of the rows share stays one entry.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do NULL
ids; distances are between vectors of equal length only, and each length has a forest of its own; repeated rows count once; ties go to the smaller
id; with fewer than k candidates all are returned; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.shared import saved

SAMPLE = 20_000
TREES = 16
LEAF = 32
REACH = 6_000
#: Up to so many bytes (8 per component) the sample grows with the table.
SAMPLE_BYTES = 32 << 20
#: Queries that are also answered by brute force, and the share of their neighbours that the reach has to find.
TRIALS = 256
RECALL = 0.95
#: Blocks of the index, or more where a block would hold more than so many bytes (8 per component).
BLOCKS = 16
BLOCK_BYTES = 16 << 20


@dataclass
class Forest:
    """Complete binary trees in heap order: ``planes`` (tree, node, dimension), ``cuts`` (tree, node)."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf number over all trees of every row of ``x``."""
        out = np.empty((len(x), len(self.planes)), np.int32)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("nd,nd->n", x, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = t * self.leaves + node - (self.leaves - 1)
        return out

    def walk(self, query: np.ndarray, sizes: np.ndarray, reach: float) -> list[int]:
        """Leaves in order of the queue until they hold ``reach`` vectors."""
        margins = self.planes @ query - self.cuts
        queue = [(-np.inf, t, 0) for t in range(len(self.planes))]
        found, held, inner = [], 0, self.leaves - 1
        while queue and held < reach:
            bound, t, node = heapq.heappop(queue)
            while node < inner:
                margin = float(margins[t, node])
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (max(bound, abs(margin)), t, 4 * node + 3 - near))
                node = near
            leaf = t * self.leaves + node - inner
            found.append(leaf)
            held += int(sizes[leaf])
        return found

    def needed(self, query: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The least reach with which the walk comes to each of the ``wanted`` vectors."""
        leaves = np.array(self.walk(query, sizes, np.inf))
        before = np.empty(len(sizes), np.int64)
        before[leaves] = np.cumsum(sizes[leaves]) - sizes[leaves]
        return before[self.place(wanted)].min(1) + 1


def fit(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 1) -> Forest:
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if n else 0
    planes, cuts = np.zeros((trees, (1 << depth) - 1, d)), np.zeros((trees, (1 << depth) - 1))
    for t in range(trees):
        below = {0: np.arange(n)}
        for node in range((1 << depth) - 1):
            own = below.pop(node)
            plane = rng.standard_normal(d)
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                plane = sample[a] - sample[b]
            plane /= np.linalg.norm(plane) or 1.0
            side = sample[own] @ plane
            planes[t, node], cuts[t, node] = plane, np.median(side) if len(own) else 0.0
            right = side > cuts[t, node]
            below[2 * node + 1], below[2 * node + 2] = own[~right], own[right]
    return Forest(planes, cuts, depth)


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lists(rows: Sequence[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Block:
    """Vectors of one block, and which of them each leaf holds."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        self.keys = np.concatenate([p["key"].to_numpy() for p in parts])
        self.first = np.concatenate([p["first"].to_numpy() for p in parts])
        # A row per component.
        self.x = np.ascontiguousarray(np.concatenate([_matrix(p["vector"]) for p in parts]).T)
        leaves = np.concatenate([p["leaves"].flatten().to_numpy() for p in parts])
        order = np.argsort(leaves, kind="stable")
        self.rows = order // max(1, len(leaves) // len(self.keys))
        self.starts = np.searchsorted(leaves[order], np.arange(leaves.max() + 2))

    def nearest(self, query: np.ndarray, leaves: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the ``n`` nearest vectors that ``leaves`` hold."""
        leaves = leaves[leaves < len(self.starts) - 1]
        asked = np.zeros(len(self.keys), bool)
        start, length = self.starts[leaves], self.starts[leaves + 1] - self.starts[leaves]
        asked[self.rows[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]] = True
        at = np.flatnonzero(asked)
        total = np.zeros(len(at))
        with np.errstate(over="ignore"):
            # In the order of the components: the same sum in every block and on every machine.
            for row, own in zip(self.x, query, strict=True):
                apart = row[at] - own
                apart *= apart
                total += apart
        score = np.sqrt(total)
        if len(at) > n:
            close = score <= np.partition(score, n - 1)[n - 1]
            at, score = at[close], score[close]
        best = np.lexsort((self.keys[at], self.first[at], score))[:n]
        return at[best], score[best]


def _ranked(indexed: DataFrame, probes: DataFrame, blocks: int, n: int) -> DataFrame:
    """``query, key, first, score``: of every block the ``n`` nearest vectors of the leaves that each query asks for.

    ``indexed`` holds ``key, first, vector, leaves``, ``probes`` ``query, vector, leaves``.  Of a block a task first gets the vectors, which it
    holds, then the queries, which stream by.
    """
    own = indexed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "*")
    asking = probes.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(1).alias("asks"),
        F.col("query").alias("key"),
        F.lit(None).cast("bigint").alias("first"),
        "vector",
        "leaves",
    )
    dealt = own.unionByName(asking).repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = -1, [], None
        for batch in batches:
            block, asks = batch["block"].to_numpy(), batch["asks"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(2 * block + asks)) + 1).tolist(), len(block)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if block[start] != at:
                    at, parts, held = block[start], [], None
                part = batch.slice(start, stop - start)
                if not asks[start]:
                    parts.append(part)
                    continue
                if held is None and parts:
                    held, parts = _Block(parts), []
                if held is None:
                    continue
                lists = np.split(part["leaves"].flatten().to_numpy(), np.cumsum(part["leaves"].value_lengths().to_numpy())[:-1])
                found = [held.nearest(q, leaves, n) for q, leaves in zip(_matrix(part["vector"]), lists, strict=True)]
                places = np.concatenate([f[0] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part["key"].to_numpy(), [len(f[0]) for f in found])),
                        pa.array(held.keys[places]),
                        pa.array(held.first[places]),
                        pa.array(np.concatenate([f[1] for f in found])),
                    ],
                    names=["query", "key", "first", "score"],
                )

    return dealt.mapInArrow(rank, "query bigint, key bigint, first bigint, score double")


def _nearest(vectors: DataFrame, trials: pa.Table, k: int) -> dict[int, np.ndarray]:
    """By brute force, the ``k`` nearest other vectors of each of the ``trials`` (``key, vector``)."""
    asked, own = _matrix(trials["vector"].combine_chunks()), trials["key"].to_numpy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for query, key in zip(asked, own, strict=True):
                score = np.einsum("nd,nd->n", x - query, x - query)
                score[keys == key] = np.inf
                best = np.argsort(score, kind="stable")[:k]
                best = best[score[best] < np.inf]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), key)), pa.array(score[best]), batch.column(0).take(pa.array(best)), batch.column(1).take(pa.array(best))],
                    names=["query", "score", "key", "vector"],
                )

    kind = vectors.schema["vector"].dataType.simpleString()
    found = vectors.select("key", "vector").mapInArrow(compare, f"query bigint, score double, key bigint, vector {kind}")
    rows = _smallest(found, "query", k, "score", "key").select("query", "vector").toArrow()  # TRIALS * k vectors at most
    queries, x = rows["query"].to_numpy(), _matrix(rows["vector"].combine_chunks())
    return {int(q): x[queries == q] for q in np.unique(queries)}


def _search_length(vectors: DataFrame, asked: DataFrame, members: DataFrame, k: int, reach: int, trees: int) -> DataFrame:
    """``asked`` and ``vectors`` hold ``key, vector`` of one length."""
    context = vectors.sparkSession.sparkContext
    length = vectors.select(F.size("vector")).first()
    most = max(SAMPLE, SAMPLE_BYTES // (8 * length[0])) if length else SAMPLE
    sample = vectors.orderBy(F.xxhash64("vector"), "key").limit(most).select("vector").toArrow()["vector"].combine_chunks()
    forest = context.broadcast(fit(_matrix(sample), trees))

    kind, asked_kind = (rows.schema["vector"].dataType.simpleString() for rows in (vectors, asked))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.value.place(_matrix(batch["vector"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(leaves)], names=["key", "first", "vector", "leaves"])

    indexed = vectors.select("key", F.col("first").cast("long"), "vector")
    indexed = saved(indexed.mapInArrow(index, f"key bigint, first bigint, vector {kind}, leaves array<int>"))
    # One number per leaf of the forest, whatever the number of vectors.
    held = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()
    sizes = np.zeros(trees * forest.value.leaves, np.int64)
    for leaf, n in held:
        sizes[leaf] = n
    counted = context.broadcast(sizes)
    trials = asked.select("key", "vector").orderBy(F.xxhash64("vector"), "key").limit(TRIALS).toArrow()
    wanted = _nearest(vectors, trials, k) if len(trials) and len(sample) else {}
    tried = zip(trials["key"].to_pylist(), _matrix(trials["vector"].combine_chunks()) if wanted else [], strict=False)
    needs = [forest.value.needed(query, sizes, wanted[key]) for key, query in tried if key in wanted]
    if needs:
        reach = max(reach, int(np.quantile(np.concatenate(needs), RECALL, method="higher")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walks = [np.array(forest.value.walk(q, counted.value, reach), np.int32) for q in _matrix(batch["vector"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(walks)], names=["query", "vector", "leaves"])

    probes = asked.select(F.col("key").alias("query"), "vector").mapInArrow(probe, f"query bigint, vector {asked_kind}, leaves array<int>")
    n_vectors = int(sizes[: forest.value.leaves].sum())
    blocks = max(BLOCKS, -(-8 * (length[0] if length else 0) * n_vectors // BLOCK_BYTES))
    scored = _ranked(indexed, probes, blocks, k + 1)
    # The nearest k + 1 different vectors hold the nearest k ids.
    nearest = _smallest(scored, "query", k + 1, "score", "first", "key")
    ids = nearest.join(members, "key").groupBy("query", "id").agg(F.min("score").alias("score"))
    return _smallest(ids, "query", k + 1, "score", "id")


def _smallest(rows: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def search(
    table: DataFrame, queries: DataFrame, k: int = 10, reach: int = REACH, trees: int = TREES
) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest found of every query but its own id.

    Both frames hold ``id, vector``.
    """
    rows = table.where(F.col("id").isNotNull() & usable("vector")).select("id", "vector").distinct()
    kept = saved(_smallest(rows, "vector", k + 1, "id"))
    keyed = kept.groupBy("vector").agg(F.min("id").alias("first"))
    keyed = saved(keyed.withColumn("key", F.monotonically_increasing_id()))
    members = saved(kept.join(keyed, "vector").select("key", "id"))
    asked = queries.where(F.col("id").isNotNull() & usable("vector")).select("id", "vector").distinct()
    # A query vector that the table lacks gets a key of its own below zero.
    known = asked.select("vector").distinct().join(keyed.drop("first"), "vector", "left")
    own = saved(known.withColumn("key", F.coalesce("key", -1 - F.monotonically_increasing_id())))
    lengths = [r[0] for r in own.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect()]
    found = None
    for length in lengths:
        same = F.size("vector") == length
        part = _search_length(keyed.where(same), own.where(same), members, k, reach, trees)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    nearest = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("nearest"))
    answers = asked.withColumnRenamed("id", "query_id").join(own.withColumnRenamed("key", "query"), "vector")
    answers = answers.select("query_id", "query").join(nearest, "query")
    others = F.slice(F.filter("nearest", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("_at", "_hit")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.id").alias("id"), F.col("_hit.score").alias("score")
    )
