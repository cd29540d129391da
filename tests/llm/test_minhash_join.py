"""The multi-index Hamming join: its guarantee, its exactness against all pairs, and its defined cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gaugework.llm import minhash_join as m
from gaugework.llm.jaccard_join import Rule
from tests.llm.conftest import DOCS

RULE = Rule(n=2, part=80, whole=100)


def shingles(text, n=2):
    words = (text or "").lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, rule=RULE):
    """The smallest id that links reach, by comparing all pairs."""
    sets = [(i, shingles(t, rule.n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and rule.whole * len(a & b) >= rule.part * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def check(docs, rows, rule=RULE):
    got = m.near_duplicates(docs(rows).repartition(3), rule).collect()
    want = brute(rows, rule)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = {(r.doc_id, r.n_shingles) for r in got}
    assert sizes == {(i, len(shingles(t, rule.n))) for i, t in rows}


def text(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


def test_every_error_within_the_limit_leaves_a_chunk():
    rng = random.Random(1)
    parts = m.chunks()
    assert sorted(np.concatenate(parts).tolist()) == list(range(m.POSITIONS))
    for _ in range(2000):
        wrong = set(rng.sample(range(m.POSITIONS), m.ERRORS))
        assert any(len(wrong & set(p.tolist())) <= m.PER_CHUNK for p in parts)


def test_pairs_within_the_limit_share_a_key(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (200, m.POSITIONS), dtype=np.uint8)
    rows = []
    for i, own in enumerate(base):
        other = own.copy()
        wrong = rng.choice(m.POSITIONS, m.ERRORS, replace=False)
        other[wrong] += 1 + rng.integers(0, 254, m.ERRORS, dtype=np.uint8)
        rows += [(2 * i, own.view(np.int64).tolist()), (2 * i + 1, other.view(np.int64).tolist())]
    nodes = spark.createDataFrame(rows, "node long, signature array<long>")
    found = {tuple(sorted((r.pivot, r.node))) for r in m._regions(nodes).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(200)} <= found
    own = m._sketched(spark.createDataFrame([(0, 1)], "pivot long, node long"), nodes, "signature")
    assert own.select(m.differing_symbols("signature_a", "signature_b")).first()[0] == m.ERRORS


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    far = []
    for _ in range(600):
        sets = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        # 100 common of 120 and 105: 0.8 of the union.
        both = [np.sort(sets[:110]), np.sort(np.concatenate([sets[:98], sets[110:]]))]
        assert len(np.intersect1d(*both)) / len(np.union1d(*both)) >= 0.8
        signed = m.signatures(np.concatenate(both), np.array([len(both[0]), len(both[0]) + len(both[1])]))
        far.append((signed[0] != signed[1]).sum())
    union = 120
    share = (union - 98) / union
    assert abs(np.mean(far) - share * m.POSITIONS) < 1.0
    assert np.std(far) < 1.15 * np.sqrt(m.POSITIONS * share * (1 - share))
    assert max(far) <= m.ERRORS


@pytest.mark.parametrize("small", [m.SMALL, 4])
def test_links_are_those_of_all_pairs(docs, monkeypatch, small):
    """Families whose members link in part, chains and strangers, compared directly and by their rarest shingles."""
    monkeypatch.setattr(m, "SMALL", small)
    rng, rows = random.Random(4), []
    for family in range(3):
        words = text(rng, 80)
        rows += [" ".join(edited(rng, words, rng.randrange(14))) for _ in range(45)]
    chain = text(rng, 60)
    for _ in range(25):
        chain = edited(rng, chain, 2)
        rows.append(" ".join(chain))
    shared = text(rng, 30)
    rows += [" ".join(shared + text(rng, rng.randrange(2, 40))) for _ in range(40)]
    rows += [" ".join(text(rng, rng.randrange(1, 60), 40)) for _ in range(60)]
    rng.shuffle(rows)
    check(docs, list(enumerate(rows)))


def test_bridge_between_two_families(docs):
    rng = random.Random(5)
    left = text(rng, 100)
    right = edited(rng, left, 16)
    rows = [" ".join(edited(rng, left, rng.randrange(3))) for _ in range(30)]
    rows += [" ".join(edited(rng, right, rng.randrange(3))) for _ in range(30)]
    half = [a if i % 2 else b for i, (a, b) in enumerate(zip(left, right))]
    rows.insert(31, " ".join(half))
    check(docs, list(enumerate(rows)))


def test_odd_rows(docs, spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (None, "A B\tc d"), (4, "word " * 30_000), (5, " \t\n"), (6, "x"), (7, "X")]
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS + ", node string, key string, pivot string, size string")
    got = sorted(map(tuple, m.near_duplicates(frame, RULE).collect()), key=repr)
    want = [(1, 3, 1, True)] * 2 + [(2, 0, 2, True), (3, 0, 3, True), (None, 3, 1, False), (4, 1, 4, True), (5, 0, 5, True)]
    assert got == sorted([*want, (6, 1, 6, True), (7, 1, 6, False)], key=repr)
    assert m.near_duplicates(docs([]), RULE).count() == 0


@pytest.mark.parametrize("small", [m.SMALL, 0])
def test_an_id_with_several_texts_links_its_classes(docs, monkeypatch, small):
    monkeypatch.setattr(m, "SMALL", small)
    rng = random.Random(6)
    a, b, c = (text(rng, 60) for _ in range(3))
    rows = [(10, " ".join(a)), (10, " ".join(b)), (11, " ".join(edited(rng, a, 2))), (12, " ".join(edited(rng, b, 2))), (13, " ".join(c))]
    got = {(r.doc_id, r.component_id) for r in m.near_duplicates(docs(rows), RULE).collect()}
    assert got == {(10, 10), (11, 10), (12, 10), (13, 13)}


@pytest.mark.parametrize("small", [0, 1 << 21])
def test_near_copies_that_do_not_link_make_few_rows(docs, monkeypatch, small):
    rng = random.Random(8)
    base = text(rng, 150)
    rows = [(i, " ".join(edited(rng, base, 11))) for i in range(150)]
    beside, made = m._beside, []

    def counted(*args):
        found = beside(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(m, "_beside", counted)
    monkeypatch.setattr(m, "SMALL", small)
    check(docs, rows)
    assert sum(made) < 1000


def test_only_what_is_looked_up_becomes_a_row(spark, docs):
    rng = random.Random(9)
    base = text(rng, 60)
    rows = [(i, " ".join(edited(rng, base, 0 if i == 0 else 20))) for i in range(40)]
    members = spark.createDataFrame(
        [(0, i, len(shingles(t)), i, i > 0, 1600, 30) for i, t in rows],
        "region long, node long, size long, component long, open boolean, pairs long, least long",
    )
    several = spark.createDataFrame([], "node long")
    listed = m._rarest(members, docs(rows), RULE, several)
    # Shingles outside the region's pivot are counted without a row each.
    assert "Generate" not in listed._jdf.queryExecution().analyzed().toString()
    got = {}
    for r in listed.collect():
        got.setdefault(r.node, []).append((r.place, r.shingle))
    for i, t in rows:
        size = len(shingles(t))
        needed = -(-80 * (size + max(30, -(-size * 80 // 100))) // 180)
        assert [place for place, _ in sorted(got[i])] == list(range(size - needed + 1))
    # All members list in one order: what two list in part of, they list in the same sequence.
    for i, j in ((1, 2), (3, 4), (5, 6)):
        a, b = ([x for _, x in sorted(got[k])] for k in (i, j))
        assert [x for x in a if x in b] == [x for x in b if x in a]
