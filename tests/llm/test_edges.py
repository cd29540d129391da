"""The defined results for NULLs, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugework.llm import byte_bpe, chat, fixity, forest_search, hamming_search, jaccard_join, packing, quality, toxicity, url_model
from gaugework.llm import components as components_module
from gaugework.llm.components import components
from gaugework.llm.shared import BATCH_BYTES, bounded_batches, written
from tests.llm.conftest import DOCS, tuples

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASHING = "doc_id long, text string, piece string, length string, score string, key string, node string, window string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], CLASHING)


ODD = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (None, "a b c d"), (4, "word " * 30_000), (5, " \t\n")]


# Packing


def test_packing_odd_rows(spark):
    got = packing.pack_documents(clashing(spark, ODD), WORDS, capacity=64).collect()
    sizes = {}
    for r in got:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes[1] == 10 and sizes[2] == sizes[3] == sizes[5] == 1 and sizes[None] == 5
    assert sizes[4] == 30_001
    assert sum(r.length for r in got) == sum(sizes.values())


def test_packing_nothing(docs):
    assert packing.pack_documents(docs([]), WORDS).count() == 0


def test_packing_keeps_the_ids(docs):
    row = packing.pack_documents(docs([(1, "hello world")]), WORDS, keep_ids=True).first()
    assert len(row.ids) == row.length and row.ids[-1] == 0


def brute_sum_of_squares(sizes, capacity):
    """Try every place and count the squares anew."""
    bins = []
    for s in sizes:
        def cost(gaps):
            held = [g for g in gaps if 0 < g < capacity]
            return sum(held.count(g) ** 2 for g in set(held))

        options = [(cost([*bins, capacity - s]), capacity - s, len(bins))]
        for i, gap in enumerate(bins):
            if gap >= s:
                options.append((cost([*bins[:i], gap - s, *bins[i + 1 :]]), gap - s, i))
        least = min(o[0] for o in options)
        yield least
        _, gap, at = min((o for o in options if o[0] == least), key=lambda o: o[1])
        bins[at : at + 1] = [gap]


def test_packer_takes_the_least_sum_of_squares():
    rng = random.Random(3)
    capacity, sizes = 20, [rng.randint(1, 20) for _ in range(200)]
    packer = packing.Packer(capacity)
    for size, least in zip(sizes, brute_sum_of_squares(sizes, capacity), strict=True):
        packer.place(size)
        held = packer.counts[1:capacity]
        assert int((held**2).sum()) == least


def test_words_encode_as_the_whole_text():
    from tokenizers import Tokenizer

    with open(WORDS, "rb") as file:
        vocabulary = file.read()
    tokenizer = Tokenizer.from_buffer(vocabulary)
    tokenizer.encode_special_tokens = True
    rng = random.Random(5)
    alphabet = list("aBcé'sÄİſ.,!?%|$&# \t\n\x0b\x1c\x85  019_-") + ["<|endoftext|>", "é", "'ll", "ß", "语", "👍🏽"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    ids, ends = packing.encode_words(pa.array(texts, pa.large_string()), vocabulary)
    start = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[start:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        start = end


def test_remembered_words_stay_the_same_over_generations(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    asked = []

    def encode(words):
        asked.extend(words)
        return {w: w.encode() for w in words}

    words, rng = packing.Words(encode), random.Random(9)
    for _ in range(200):
        own = ["often", "x" * 40, "", *(f"w{rng.randrange(300)}" for _ in range(8))]
        own = list(dict.fromkeys(own))
        assert words.ids(own) == [w.encode() for w in own]
        assert len(words.young) <= 20 + len(own) and len(words.old) <= 20 + len(own)
    assert asked.count("often") == 1 and asked.count("x" * 40) == 200


# Byte-level BPE


def test_byte_bpe_round_trip(spark):
    got = byte_bpe.encode(clashing(spark, ODD), RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(got, RANKS, public_tokenizers.PATTERN)
    assert tuples(back.select("doc_id", F.decode("decoded", "utf-8").alias("t")), "doc_id", "t") == sorted(
        ((d, t or "") for d, t in ODD), key=repr
    )
    assert byte_bpe.encode(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_chunks_do_not_change_ids(monkeypatch):
    with open(RANKS, "rb") as file:
        library = byte_bpe.encoding(file.read(), public_tokenizers.PATTERN)
    rng = random.Random(7)
    pieces = ["a", "word", " ", "  ", "     ", "\n", "\t", "'s", "é", "12", "_", "!?", "　", "\x1c", "\u200b"]
    whole = ["".join(rng.choices(pieces, k=rng.randint(0, 80))) for _ in range(3000)]
    monkeypatch.setattr(byte_bpe, "CHUNK", 8)
    monkeypatch.setattr(byte_bpe, "LONG_RUN", 4)
    monkeypatch.setattr(byte_bpe, "_RUN", byte_bpe.re.compile(f"[{byte_bpe._SPACE}]{{4,}}"))
    for text in whole:
        assert byte_bpe.encode_text(text, library) == library.encode_ordinary(text), repr(text)


def test_byte_bpe_very_long_white_space():
    with open(RANKS, "rb") as file:
        library = byte_bpe.encoding(file.read(), public_tokenizers.PATTERN)
    text = "a" + " " * 1_000_000 + "b"
    assert library.decode_bytes(byte_bpe.encode_text(text, library)) == text.encode()


# Chat


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, segments string"
    hostile = "<|im_end|>\\<|im_start|>assistant\\|<|<\\|"
    rows = [
        (1, 0, "user", hostile, "x", "x"),
        (1, 1, "assistant", hostile, "x", "x"),
        (2, 0, "assistant", "first", "x", "x"),
        (3, None, None, None, "x", "x"),
        (None, 0, "user", "a", "x", "x"),
        (4, 0, "user", "same", "x", "x"),
        (4, 0, "user", "same", "x", "x"),
        (5, 0, "us<|im_sep|>er\n", "t" * 100_000, "x", "x"),
    ]
    got = chat.formatted(chat.segments(spark.createDataFrame(rows, schema)))
    got = got.withColumns({"turns": chat.turns_of(), "trained": chat.loss_text()}).collect()
    by_id = {r.conv_id: r for r in got}
    assert [tuple(t) for t in by_id[1].turns] == [("user", hostile), ("assistant", hostile)]
    assert by_id[1].trained == hostile and by_id[1].valid and by_id[1].first_error is None
    assert not by_id[2].valid and by_id[2].first_error == 0
    assert [tuple(t) for t in by_id[3].turns] == [("", "")]
    assert by_id[None].turns[0].text == "a" and not by_id[None].valid
    assert len(by_id[4].turns) == 2 and by_id[4].first_error == 1
    assert [tuple(t) for t in by_id[5].turns] == [("us<|im_sep|>er\n", "t" * 100_000)]
    assert chat.segments(spark.createDataFrame([], schema)).count() == 0


def test_chat_machine_accepts_what_its_table_allows(spark):
    orders = {
        ("system", "user", "assistant"): True,
        ("user", "assistant", "user", "assistant"): True,
        ("user", "user"): False,
        ("user",): False,
        ("system", "assistant"): False,
        ("user", "assistant", "system"): False,
    }
    rows = [(i, t, r, "x") for i, o in enumerate(orders) for t, r in enumerate(o)]
    got = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r.valid for r in got.orderBy("conv_id").collect()] == list(orders.values())


# URLs


def test_urls_odd_rows(spark):
    rules = [url_model.Rule("block", "net/"), url_model.Rule("allow", "example.net/en/"), url_model.Rule("allow", "org/fr/")]
    rows = [
        (1, "HTTP://WWW.Example.NET/en/1?x#y", "a", "b"),
        (2, "http://example.net/En/1", "a", "b"),
        (3, None, "a", "b"),
        (4, "no scheme", "a", "b"),
        (5, "http://x.net", "a", "b"),
        (None, "http://notexample.net/en/", "a", "b"),
        (7, "http://a.org/fr/x://b.net/", "a", "b"),
        (7, "http://a.org/fr/x://b.net/", "a", "b"),
        (8, "http://c.com/" + "long/" * 2_000, "a", "b"),
    ]
    got = url_model.judged(spark.createDataFrame(rows, "page_id long, url string, rule string, score string"), rules)
    by_id = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert (by_id[1].host, by_id[1].path, by_id[1].rule, by_id[1].verdict) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (by_id[2].rule, by_id[2].verdict) == ("net/", "block")
    assert (by_id[3].host, by_id[3].path, by_id[3].rule) == ("", "", None) and by_id[3].verdict == "allow"
    assert (by_id[4].host, by_id[4].path, by_id[4].rule) == ("", "", None)
    assert (by_id[5].host, by_id[5].path, by_id[5].rule) == ("x.net", "", None)
    assert (by_id[None].rule, by_id[None].verdict) == ("net/", "block")
    assert (by_id[7].host, by_id[7].path, by_id[7].rule) == ("a.org", "/fr/x://b.net/", "org/fr/")
    empty = url_model.judged(spark.createDataFrame([], "page_id long, url string"), rules)
    assert empty.count() == 0


def test_url_model_tells_kinds_apart(spark):
    rules = [url_model.Rule("allow", "good.org/"), url_model.Rule("block", "spam.biz/")]
    rows = [(i, f"http://good.org/article/history-{i}") for i in range(60)]
    rows += [(100 + i, f"http://spam.biz/xx-win-cash-{i}") for i in range(60)]
    rows += [(900, "http://other.com/article/history-5"), (901, "http://other.com/xx-win-cash-9")]
    got = {r.page_id: r for r in url_model.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert (got[900].verdict, got[901].verdict) == ("allow", "block")


# Jaccard join


def brute_components(rows, rule):
    sets = {}
    for doc_id, text in rows:
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split() if w]
        grams = [" ".join(words[i : i + rule.n]) for i in range(len(words) - rule.n + 1)] or ([" ".join(words)] if words else [])
        sets[doc_id] = set(grams)
    names = dict.fromkeys(sets)
    parent = {d: d for d in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and rule.whole * common >= rule.part * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((d, len(sets[d]), root(d)) for d in sets)


@pytest.mark.parametrize("rule", [jaccard_join.Rule(4, 85, 100), jaccard_join.Rule(2, 50, 100), jaccard_join.Rule(1, 80, 100)])
def test_jaccard_join_against_all_pairs(spark, docs, monkeypatch, rule):
    # Small regions are compared by pivots too, so every level of the recursion is used.
    monkeypatch.setattr(jaccard_join, "SMALL", 60)
    monkeypatch.setattr(jaccard_join, "GROWTH", 2)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = rng.choices(vocabulary, k=20)
    rows = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 120)) + (passage if family % 2 else [])
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = jaccard_join.near_duplicates(docs(rows), rule)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, rule), key=repr)


def test_jaccard_join_finds_one_bridge_between_two_families(spark, docs):
    # Every member links to a pivot of its own family; only the last two rows link across, and to no other family's pivot.
    core, one, two = ([f"{c}{i}" for i in range(n)] for c, n in (("c", 100), ("a", 16), ("b", 16)))
    texts = [[*core, *one, f"u{i}"] for i in range(140)] + [[*core, *two, f"v{i}"] for i in range(140)]
    # Frequent words come last in the order, so both families share their regions.
    texts += [[*one, *two, *(f"f{i}_{j}" for j in range(9))] for i in range(300)]
    texts += [[*core, *one[:10]], [*core, *two[:10]]]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    rule = jaccard_join.Rule(1, 80, 100)
    want = brute_components(rows, rule)
    assert [c for _, _, c in want[:280] + want[-2:]] == [0] * 282
    got = jaccard_join.near_duplicates(docs(rows), rule)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_jaccard_join_of_near_copies_that_do_not_link_makes_few_rows(docs, monkeypatch):
    rng = random.Random(5)
    base, rows = [f"w{rng.randrange(9000)}" for _ in range(100)], []
    for i in range(200):
        words, at = list(base), rng.randrange(5, 90)
        words[at], words[at + 2] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(words)))
    rows.append((200, rows[7][1] + " z"))
    measured, made = jaccard_join.measured, []

    def counted(pairs, *args):
        made.append(pairs.count())
        return measured(pairs, *args)

    monkeypatch.setattr(jaccard_join, "measured", counted)
    rule = jaccard_join.Rule(n=4, part=85, whole=100)
    got = jaccard_join.near_duplicates(docs(rows), rule).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, rule)
    assert sum(made) < 9000, made


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.near_duplicates(clashing(spark, [*ODD, (6, "A B\tC D"), (7, "x y"), (7, "a b c d"), (8, "X\x0by"), (9, "É x y z"), (10, "é x y z")]), jaccard_join.Rule(4, 85, 100))
    rows = tuples(got, "doc_id", "n_shingles", "component_id")
    assert rows.count((1, 1, 1)) == 2 and (2, 0, 2) in rows and (3, 0, 3) in rows and (5, 0, 5) in rows
    assert (None, 1, 1) in rows and (6, 1, 1) in rows
    # The two texts of 7 connect "x y" with "a b c d".
    assert rows.count((7, 1, 1)) == 2 and (8, 1, 1) in rows
    assert (9, 1, 9) in rows and (10, 1, 10) in rows
    assert (4, 1, 4) in rows
    empty = jaccard_join.near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 5), (7, 3)]
    rng.shuffle(edges)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components_module, "written", lambda df: made.append(written(df)) or made[-1])
    stars = [(100, 100 + i) for i in range(1, 30)] + [(7, 3), (3, 7), (9, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(stars, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(100, 130), 100), 3: 3, 7: 3, 9: 3}
    assert len(made) == 1


def test_jaccard_join_shuffles_windows_and_sketches_once(spark, docs, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:20], *(rng.choice(words) for _ in range(20))])) for i in range(20)]
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(jaccard_join, "written", planned)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        jaccard_join.near_duplicates(docs(rows), jaccard_join.Rule(n=1, part=80, whole=100)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    windows = [p for p in plans if "posexplode(window" in p]
    assert windows and all(p.count("Generate posexplode") == 1 for p in windows)
    sketched = [p for p in plans if "_apart" in p]
    assert sketched and all("ReusedExchange" in p for p in sketched)


def test_jaccard_join_leaves_out_what_meets_too_deep(docs, monkeypatch):
    rows = []
    for c in "ab":
        frequent = [f"{c}{i}" for i in range(84)]
        rows.append((len(rows), " ".join([*(f"own_{c}{i}" for i in range(15)), "shared", *frequent])))
        for k in range(3):
            rows.append((len(rows), " ".join([*frequent, *(f"rare_{c}{k}_{i}" for i in range(60))])))
    measured, made = jaccard_join.measured, []

    def counted(pairs, *args):
        made.append(pairs.count())
        return measured(pairs, *args)

    monkeypatch.setattr(jaccard_join, "measured", counted)
    rule = jaccard_join.Rule(1, 80, 100)
    got = jaccard_join.near_duplicates(docs(rows), rule).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, rule)
    assert sum(made) == 0, made


def test_jaccard_join_plans_of_a_round_stay_small(docs, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:20], *(rng.choice(words) for _ in range(20))])) for i in range(20)]
    unconnected, plans = jaccard_join._unconnected, []

    def planned(members):
        plans.append(members._jdf.queryExecution().optimizedPlan().toString())
        return unconnected(members)

    monkeypatch.setattr(jaccard_join, "_unconnected", planned)
    jaccard_join.near_duplicates(docs(rows), jaccard_join.Rule(n=1, part=80, whole=100)).collect()
    assert len(plans) > 1 and not any("Join" in p or "Aggregate" in p for p in plans)


def test_shingles_give_back_what_a_slice_took(monkeypatch):
    texts = [" ".join(f"w{i}_{k}" for k in range(200)) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], names=["doc_id", "text"])
    released = []

    class Pool:
        def release_unused(self):
            released.append(1)

    monkeypatch.setattr(jaccard_join.pa, "default_memory_pool", Pool)
    found = list(jaccard_join._each_slice(iter([batch]), 4))
    assert len(found) > 1 and len(released) == len(found)
    assert sum(len(hashes) for _, hashes, _ in found) == 4000 * 197


# Searches


def test_hamming_search_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(60, 90)] + [(90, rows[1][1] ^ 1), rows[5], (None, 3), (91, None)]
    frame = spark.createDataFrame(rows, "id long, code long")
    got = hamming_search.search(frame, frame.where("id % 7 = 0"), k=5)
    held = {i: c for i, c in rows if i is not None and c is not None}
    want = []
    for q in (i for i in held if i % 7 == 0):
        near = sorted((bin((held[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in held.items() if i != q)
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:5])]
    assert tuples(got, "query_id", "rank", "id", "distance") == sorted(want, key=repr)


def test_hamming_search_with_clashing_columns(spark):
    rows = [(i, i, -1, "x", 2, 3, 4) for i in range(4)]
    frame = spark.createDataFrame(rows, "id long, code long, far int, held string, query long, segment int, value long")
    got = hamming_search.search(frame, frame.where("id = 0"), k=2)
    assert tuples(got, "query_id", "rank", "id", "distance") == [(0, 1, 1, 1), (0, 2, 2, 1)]


def test_hamming_search_with_few_or_no_rows(spark):
    schema = "id long, code long"
    few = spark.createDataFrame([(1, 5), (2, -1)], schema)
    assert tuples(hamming_search.search(few, few, k=10), "query_id", "id") == [(1, 2), (2, 1)]
    none = spark.createDataFrame([], schema)
    assert hamming_search.search(none, none).count() == 0


def test_sign_codes(spark):
    frame = spark.createDataFrame(
        [([1.0, -1.0, 2.0],), ([],), (None,), ([1.0, None],), ([float("nan")],), ([float("inf")],)], "v array<float>"
    )
    assert [r[0] for r in frame.select(hamming_search.sign_code("v")).collect()] == [5, 0, None, None, None, None]


def test_forest_search_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(40)]
    rows += [(40 + i, rows[0][1]) for i in range(30)]
    rows += [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0, None]), (None, rows[3][1]), (104, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, vector array<float>, key string, leaf int")
    got = forest_search.search(frame, frame.where("id % 10 = 0"), k=10).toPandas()
    usable = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i < 100}
    for q in (i for i in usable if i % 10 == 0):
        near = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own.id.tolist() == [i for _, i in near]
        assert own.score.tolist() == pytest.approx([d for d, _ in near], abs=1e-12)
    assert set(got.query_id) == {i for i in usable if i % 10 == 0}
    none = frame.where("false")
    assert forest_search.search(none, none).count() == 0


def test_forest_search_recall_on_a_table_far_beyond_its_reach(spark):
    vectors = np.random.default_rng(3).standard_normal((6000, 24)).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<float>")
    got = forest_search.search(frame, frame.where("id % 100 = 0"), k=10, reach=300).toPandas()
    hits = 0
    for q in range(0, 6000, 100):
        near = [i for i in np.argsort(((vectors - vectors[q]) ** 2).sum(1), kind="stable") if i != q][:10]
        hits += len({*near} & {*got[got.query_id == q].id})
    assert hits >= 0.9 * 600


@pytest.mark.parametrize("operator", ["near_duplicates", "toxicity", "quality"])
def test_texts_go_to_python_in_short_batches(spark, operator):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def batches(frame):
        def size(each):
            for batch in each:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

        return [r[0] for r in frame.mapInArrow(size, "bytes long").collect()]

    long = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    few = spark.createDataFrame([(1, "a b c d")], DOCS)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    own = spark.conf.get(setting, None)
    try:
        spark.conf.unset(setting)
        {
            "near_duplicates": lambda: jaccard_join.near_duplicates(few),
            "toxicity": lambda: toxicity.toxicity(few, labels),
            "quality": lambda: quality.quality(few, labels),
        }[operator]()
        sizes = batches(long)
        assert sum(sizes) > 15_000_000 and max(sizes) < 2 * BATCH_BYTES
        # A bound of the caller's own is kept.
        spark.conf.set(setting, "1000000")
        bounded_batches(spark)
        assert spark.conf.get(setting) == "1000000"
    finally:
        spark.conf.unset(setting) if own is None else spark.conf.set(setting, own)


def test_forest_search_makes_no_row_per_candidate(spark, monkeypatch):
    vectors = np.random.default_rng(4).standard_normal((2000, 16)).astype(np.float32).astype(float)
    vectors[1000:1100] = vectors[40]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<float>")
    ranked, smallest = [], forest_search._smallest

    def counted(rows, by, n, *order):
        if by == "query":
            ranked.append(rows.count())
        return smallest(rows, by, n, *order)

    monkeypatch.setattr(forest_search, "_smallest", counted)
    got = forest_search.search(frame, frame.where("id % 40 = 0"), k=10).toPandas()
    # The reach takes in the whole table: 50 queries times 1901 different vectors are candidates.
    assert max(n for n in ranked[1:]) <= 50 * 16 * 11
    for q in range(0, 2000, 40):
        distance = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        near = [i for i in np.lexsort((np.arange(2000), distance)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own.id.tolist() == near
        assert own.score.tolist() == pytest.approx(distance[near].tolist(), rel=1e-12)


# Fixity


def archive(spark, rows):
    return fixity.placed(fixity.digests(spark.createDataFrame(rows, "page_id long, url string, html string")), per_file=4)


def test_fixity_locates_each_fault(spark, monkeypatch):
    monkeypatch.setattr(fixity, "FANOUT", 2)
    monkeypatch.setattr(fixity, "RANGE_BYTES", 256)
    rows = [(i, f"http://x/{i}", "p" * (i * 7 % 90)) for i in range(-3, 60)] + [(60, None, None), (None, "u", "h"), (5, "http://x/5", "p" * 35)]
    mine = archive(spark, rows)
    damaged = mine.where("id != 17").withColumn("digest", F.when(F.col("id").isin(3, 44), "bad").otherwise(F.col("digest")))
    extra = mine.where("id = 50").withColumns({"id": F.lit(99).cast("long"), "offset": F.col("offset") + 1})
    own, other = fixity.trees(mine, damaged.unionByName(extra))
    assert tuples(fixity.audit(own, other), "id", "fault") == [(17, "missing"), (3, "changed"), (44, "changed"), (99, "extra")]
    assert own[-1].count() == other[-1].count() == 1


def test_fixity_audits_every_record_of_a_repeated_id(spark):
    rows = [(i, f"http://x/{i}", f"p{i}") for i in range(8)] + [(3, "http://x/3", f"other {j}") for j in range(30)] + [(3, "http://x/3", "p3")] * 4
    schema = "page_id long, url string, html string"
    mine = archive(spark, rows)
    assert mine.count() == len(rows)
    ends = {r.offset + r.length for r in mine.where("file = 0").collect()}
    assert {r.offset for r in mine.where("file = 0").collect()} == {0, *ends} - {max(ends)}
    # Of id 3, each single record in turn is lost or changed, and one copy of the equal ones is.
    first = {(r.digest, r.copy): r.offset for r in mine.where("id = 3").collect()}
    for row in [min(first), max(first)]:
        gone = mine.where(~((F.col("digest") == row[0]) & (F.col("copy") == row[1])))
        theirs = fixity.held(gone.select("id", "digest", "length", "copy"), mine, per_file=4)
        found = fixity.audit(*fixity.trees(mine, theirs))
        assert tuples(found, "id", "offset", "fault") == [(3, first[row], "missing")]
    damaged = [(i, u, "#ther 7" if h == "other 7" else h) for i, u, h in rows[:-1]] + [(5, "http://x/5", "new")]
    theirs = fixity.held(fixity.digests(spark.createDataFrame(damaged, schema)), mine, per_file=4)
    faults = [(i, f) for i, f in tuples(fixity.audit(*fixity.trees(mine, theirs)), "id", "fault")]
    assert faults == [(3, "changed"), (3, "missing"), (5, "extra")]


def test_fixity_of_equal_and_empty_replicas(spark):
    mine = archive(spark, [(1, "a", "b"), (2, None, "")])
    assert fixity.audit(*fixity.trees(mine, mine)).count() == 0
    none = mine.where("false")
    assert fixity.audit(*fixity.trees(none, none)).count() == 0
    assert tuples(fixity.audit(*fixity.trees(mine, none)), "id", "fault") == [(1, "missing"), (2, "missing")]


# Classifiers

LABELS = "doc_id long, quality int, toxic int"


def test_quality_learns_and_scores_odd_rows(spark):
    rng = random.Random(1)
    words = ["river", "stone", "morning", "paper", "window", "garden", "letter", "silver"]
    rows = [(i, " ".join(rng.choices(words, k=60)) + ".") for i in range(120)]
    rows += [(200 + i, " | ".join(w.upper() + "%%%" for w in rng.choices(words, k=60))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i < 200), None) for i, _ in rows] + [(None, 1, 1), (1, None, 0)], LABELS)
    train = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], CLASHING)
    model = quality.fit(train, labels, F.col("doc_id") % 2 == 0)
    got = quality.scored(clashing(spark, [*rows, *ODD]), model).collect()
    assert len(got) == len(rows) + len(ODD)
    scores = {r.doc_id: r.score for r in got}
    held = [i for i, _ in rows if i % 2 and i > 5]
    assert np.mean([(scores[i] >= 0.5) == (i < 200) for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_classifiers_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.quality(docs(ODD), none).collect()} == {1.0}
    assert all(r.score < 0.01 for r in toxicity.toxicity(docs(ODD), none).collect())
    assert quality.quality(docs([]), none).count() == toxicity.toxicity(docs([]), none).count() == 0


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(6)
    words = ["river", "stone", "morning", "paper", "window", "garden", "letter", "silver"]
    rows = []
    for i in range(300):
        text = rng.choices(words, k=40)
        if i % 3 == 0:
            text[5] = rng.choice(["vilest", "grubb" + rng.choice("abcdef")])
            text[9] = "grubb" + rng.choice("abcdef")
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i, _ in rows], LABELS)
    model = toxicity.fit(clashing(spark, rows), labels, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.score for r in toxicity.scored(clashing(spark, [*rows, (999, "GRUBBZ grubbx"), *ODD]), model).collect()}
    held = [i for i, _ in rows if i % 2 and i > 5]
    assert np.mean([(got[i] >= 0.7) == (i % 3 == 0) for i in held]) >= 0.97
    assert got[999] >= 0.7 and got[3] < 0.5


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.2
    good = [np.where(truth, np.where(rng.random(2000) < 0.8, 1, 0), np.where(rng.random(2000) < 0.9, -1, 1)) for _ in range(4)]
    noisy = np.where(rng.random(2000) < 0.5, np.where(truth, 1, -1), rng.choice([-1, 1], 2000))
    votes = np.stack([*good, *[noisy] * 12], 1)
    posterior = toxicity.label_model(votes, 0.2)
    assert ((posterior > 0.5) == truth).mean() > 0.93
