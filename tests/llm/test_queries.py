"""Every query of the folder over whole tables: against its SQL where it has some, else against brute force."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugework.llm.queries import ORACLES, QUERIES
from gaugework.llm.shared import table
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small_db, name):
    got = QUERIES[name](spark, SF_DIR)
    want = small_db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    expected = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected


def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}


def test_packing_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    got = QUERIES["op1_pack_documents"](spark, SF_DIR).toPandas()
    by_doc = dict(tuple(got.sort_values("piece").groupby("doc_id")))
    for doc_id, text in texts(spark).items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        rows = by_doc[doc_id]
        parts = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert rows.piece.tolist() == list(range(len(parts)))
        assert rows.start.tolist() == [2048 * i for i in range(len(parts))]
        assert rows.length.tolist() == [len(p) for p in parts]
        assert rows.ids_crc32.tolist() == [zlib.crc32(p.tobytes()) for p in parts]
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]]
        assert rows.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.03 * np.ceil(got.length.sum() / 2048) + 3


def test_byte_bpe_is_that_of_the_library(spark):
    from gaugework.llm.byte_bpe import encoding

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        library = encoding(file.read(), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, SF_DIR).collect()}
    for doc_id, text in texts(spark).items():
        ids = library.encode_ordinary(text)
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_forest_search_recall_and_scores(spark):
    rows = table(spark, SF_DIR, "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], np.float64)
    got = QUERIES["op8_forest_search"](spark, SF_DIR).toPandas().sort_values("rank")
    hits = wanted = 0
    for at in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((vectors - vectors[at]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, distance)) if i != at][:10]
        own = got[got.query_id == ids[at]]
        assert own["rank"].tolist() == list(range(1, len(order) + 1))
        assert own.score.is_monotonic_increasing
        for r in own.itertuples():
            assert r.score == pytest.approx(distance[ids == r.vec_id][0], rel=1e-12)
        hits += len(set(own.vec_id) & set(ids[order]))
        wanted += len(order)
    assert hits >= 0.9 * wanted


@pytest.mark.parametrize(
    ("name", "label", "caught", "false_alarms"), [("op5_toxicity", "toxic", 0.75, 0.02), ("op7_quality", "quality", 0.97, 0.25)]
)
def test_classifiers_on_rows_they_have_not_seen(spark, name, label, caught, false_alarms):
    """Recall of label 1, and how often label 0 is called 1, on held-out rows."""
    sf_dir = SF_DIR.replace("0.001", "0.1")
    got = QUERIES[name](spark, sf_dir).cache()
    documents = table(spark, sf_dir, "documents").count()
    assert got.count() == documents
    assert got.where("score < 0 or score > 1 or score is null").isEmpty()
    judged = got.join(table(spark, sf_dir, "labels"), "doc_id").where(F.col("held_out") & F.col(label).isNotNull())
    rates = {r[label]: (r.rate, r.n) for r in judged.groupBy(label).agg(F.avg("predicted").alias("rate"), F.count("*").alias("n")).collect()}
    assert rates[1][1] > 50 and rates[0][1] > 50
    assert rates[1][0] >= caught, rates
    assert rates[0][0] <= false_alarms, rates


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, SF_DIR)
        assert kept.columns == rows.columns, name
        assert kept.exceptAll(rows).isEmpty(), name
        assert 0.5 * rows.count() < kept.count() <= rows.count(), name
        rows = spark.createDataFrame(kept.collect(), rows.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR)
    assert packed.select("doc_id").distinct().count() == rows.count()


def test_pipeline_keeps_its_numbers_when_the_input_is_split_anew(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(40)] + [(40, " ".join(f"w3x{j}" for j in range(20)))]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)

    def split(size):
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.set(f"spark.sql.files.{name}", size)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    def number(spark, docs, sf_dir):
        return docs.withColumn("n", F.monotonically_increasing_id())

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("number", number)])
    names = ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")
    before = {name: spark.conf.get(f"spark.sql.files.{name}", None) for name in names}
    try:
        split("1g")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(path), str(tmp_path))
        ran = corpus_pipeline.run(spark, str(tmp_path))
        first = sorted(map(tuple, ran.collect()))
        split("64")
        got = sorted(r.doc_id for r in kept.collect())
        again = sorted(map(tuple, ran.collect()))
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(f"spark.sql.files.{name}")
            else:
                spark.conf.set(f"spark.sql.files.{name}", value)
    assert len(got) == 40 and set(range(40)) - {3} <= set(got)
    assert again == first
