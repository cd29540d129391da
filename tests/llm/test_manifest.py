"""The manifest against a plain build of the same trees, and its defined cases."""

from __future__ import annotations

import hashlib
import random

import pytest

from gaugework.llm import manifest as m

ROWS = "group string, id long, leaf string, shown string, tree string, index string, path string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes, arity):
    """All levels of a tree."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([digest("".join(rows[-1][i : i + arity])) for i in range(0, len(rows[-1]), arity)])
    return rows


def siblings(rows, at, arity):
    for level in rows[:-1]:
        run = at - at % arity
        yield level[run:at], level[at + 1 : run + arity]
        at //= arity


def brute(rows, arity=2):
    """``(id, leaf, subroot, root, proof, folded)`` of every ``(group, id, leaf, shown)``."""
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
        trees[g] = climb([r[2] for r in groups[g]], arity)
    top = climb([trees[g][-1][0] for g in order], arity)
    for at, g in enumerate(order):
        for place, (_, own, leaf, shown) in enumerate(groups[g]):
            levels = [*siblings(trees[g], place, arity), *siblings(top, at, arity)]
            folded = shown or leaf
            for left, right in levels:
                folded = digest("".join([*left, folded, *right]))
            yield own, leaf, trees[g][-1][0], top[-1][0], "".join("".join(x + y) for x, y in levels), folded


def check(spark, rows, arity=2):
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], ROWS).repartition(5)
    got = m.manifest(frame, arity).collect()
    # Equal leaves are interchangeable: places are handed out among them.
    told = sorted((repr(r.id), r.leaf, r.subroot, r.root, "".join(r.proof), r.folded_root) for r in got)
    assert told == sorted((repr(w[0]), *w[1:]) for w in brute(rows, arity))
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def some(n, seed, ids, groups=("a", "b", None, "é", "")):
    rng = random.Random(seed)
    rows = []
    for i in ids(rng, n):
        leaf = digest(f"{i}{seed}")
        rows.append((rng.choice(groups), i, leaf, digest(leaf) if rng.random() < 0.2 else None))
    return rows


SPREAD = {
    "dense": lambda rng, n: range(n),
    "sparse": lambda rng, n: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)],
    "word ends": lambda rng, n: [w * 64 + b for w in range(-n // 8, n // 8) for b in (0, 1, 62, 63)],
    "far apart": lambda rng, n: [-(1 << 63), (1 << 63) - 1, -1, 0, *range(1000, 1000 + n)],
}


@pytest.mark.parametrize("ids", sorted(SPREAD))
def test_trees_of_every_id_distribution(spark, ids):
    check(spark, some(1500, 1, SPREAD[ids]))


@pytest.mark.parametrize(("n", "arity"), [(2, 2), (257, 2), (300, 300)])
def test_sizes_and_arities(spark, n, arity):
    check(spark, some(n, n, SPREAD["dense"], groups=("only",)), arity)


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(m, "SLOTS", 4)
    check(spark, some(300, 3, SPREAD["dense"]))
    check(spark, some(60, 4, SPREAD["dense"], groups=[f"g{i}" for i in range(40)]))


def test_repeated_ids_and_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "COPIES", 7)
    rows = some(200, 5, SPREAD["dense"], groups=("a", None))
    # One id with many texts, one row many times, ids that are NULL.
    rows += [("a", 77, digest(f"text {i % 30}"), None) for i in range(120)]
    rows += [("a", 63, digest("same"), None)] * 50 + [("a", None, digest(f"n{i}"), None) for i in range(20)]
    rows += [(None, None, digest("n"), digest("m"))] * 3
    check(spark, rows)


def test_nothing(spark):
    assert m.manifest(spark.createDataFrame([], ROWS)).count() == 0


def test_leaf_of_nulls_and_multibyte_text(spark):
    frame = spark.createDataFrame([(None, "é", 5), (7, None, None), (8, "", 1)], "id long, text string, n int")
    got = [r[0] for r in frame.select(m.leaf_digest(frame.id, frame.text, frame.n)).collect()]
    assert got == [digest("-2:é1:5"), digest("1:7--"), digest("1:80:1:1")]
