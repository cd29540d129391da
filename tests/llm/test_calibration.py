"""The calibration curve against a slow optimiser, on separable and resampled data; the pipeline's stages on odd tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugework.llm.quality import RIDGE, calibrated, curve
from gaugework.llm.shared import table
from tests.conftest import SF_DIR

LARGER = SF_DIR.replace("0.001", "0.1")


def loss(x, y, weights, intercept):
    scale = x.std(0)
    scale[scale == 0] = 1
    centred = intercept + weights @ x.mean(0)
    margin = (2 * y - 1) * (x @ weights + intercept)
    return np.logaddexp(0, -margin).sum() + RIDGE * ((weights * scale) ** 2).sum() / 2 + 1e-6 * centred**2 / 2


def descended(x, y, rounds=20_000):
    """Plain gradient descent on the same loss."""
    scale = x.std(0)
    scale[scale == 0] = 1
    z = np.hstack([(x - x.mean(0)) / scale, np.ones((len(y), 1))])
    ridge = np.array([RIDGE] * x.shape[1] + [1e-6])
    beta, rate = np.zeros(z.shape[1]), 4 / (np.linalg.norm(z, 2) ** 2 + RIDGE)
    for _ in range(rounds):
        beta -= rate * (z.T @ (1 / (1 + np.exp(-z @ beta)) - y) + ridge * beta)
    weights = beta[:-1] / scale
    return weights, beta[-1] - weights @ x.mean(0)


def samples():
    rng = np.random.default_rng(11)
    for n in (20, 100, 600):
        for gap in (0.0, 0.02, 0.2, 5.0):
            for share in (0.03, 0.5, 0.9):
                y = (rng.random(n) < share).astype(float)
                y[:2] = 0, 1
                x = np.column_stack([gap * y + rng.normal(0, 0.02, n), 0.4 + rng.normal(0, 0.05, n)])
                yield x, y


def test_curve_is_the_optimum():
    for at, (x, y) in enumerate(samples()):
        own = loss(x, y, *curve(x, y))
        assert own <= loss(x, y, np.zeros(2), float(np.log(y.mean() / (1 - y.mean())))) + 1e-9
        if at % 4 == 0:
            assert own <= loss(x, y, *descended(x, y)) + 1e-6


def test_curve_of_resampled_separable_data_keeps_the_good():
    rng = np.random.default_rng(12)
    y = np.repeat([0.0, 1.0], [140, 900])
    x = np.column_stack([np.where(y == 1, 0.03, -0.05) + rng.normal(0, 0.012, len(y)), 0.42 + rng.normal(0, 0.04, len(y))])
    for size in (100, 300, 1040):
        for _ in range(150):
            own = rng.integers(0, len(y), size)
            if 0 < y[own].sum() < size:
                weights, intercept = calibrated(x[own], y[own])
                assert weights[0] > 0
                score = 1 / (1 + np.exp(-(x @ weights + intercept)))
                assert (score[y == 1] >= 0.3).mean() > 0.95
                assert (score[y == 0] < 0.3).mean() > 0.8


def test_curve_of_a_feature_that_says_nothing_or_the_opposite():
    y = np.array([0.0, 1.0] * 50)
    weights, intercept = calibrated(np.zeros((100, 2)), y)
    assert weights.tolist() == [0, 0] and intercept == pytest.approx(0)
    weights, _ = calibrated(np.column_stack([-y, y]), y)
    assert weights[0] >= 0


@pytest.mark.parametrize(("name", "label", "bad", "limit"), [("quality_classifier", "quality", 0, 0.3), ("toxicity", "toxic", 1, 0.7)])
def test_classifier_stage_follows_the_labels(spark, name, label, bad, limit):
    """Most of what is labelled bad goes and nearly all that is good stays."""
    docs = table(spark, LARGER, "documents")
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, LARGER).select("doc_id").withColumn("kept", F.lit(1))
    judged = table(spark, LARGER, "labels").where(F.col(label).isNotNull()).join(docs.select("doc_id"), "doc_id")
    share = judged.join(kept, "doc_id", "left").groupBy(F.col(label)).agg(F.avg(F.coalesce("kept", F.lit(0))).alias("kept"))
    by = {r[label]: r.kept for r in share.collect()}
    assert by[1 - bad] >= 0.97, by
    assert by[bad] <= 0.25, by


ODD = "doc_id long, text string, score string, Lang string, _row string, node string, sequence_id string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_filter_stages_keep_columns_and_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = table(spark, SF_DIR, "documents").where("doc_id % 17 = 3").select("doc_id", "text").limit(4).collect()
    rows = [(r.doc_id, r.text, f"s{r.doc_id}", "l", "r", "n", "q") for r in plain]
    rows += [rows[0], rows[0], (None, rows[1][1], "s", "l", "r", "n", "q"), (-1, None, "s", "l", "r", "n", "q"), (-2, "", "s", "l", "r", "n", "q")]
    docs = spark.createDataFrame(rows, ODD)
    kept = stage(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert set(got) <= set(rows)
    if name == "ngram_jaccard_join":
        assert len(got) == len({r[1] for r in rows if r[1]}) + 2
    else:  # repeated rows share their fate
        assert all(got.count(r) == rows.count(r) for r in got)
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_packing_stage_on_odd_rows(spark):
    pack = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    docs = spark.createDataFrame([(1, "a b", *"abcde"), (1, "a b", *"abcde"), (None, None, *"abcde")], ODD)
    assert sorted(r.length for r in pack(spark, docs, SF_DIR).collect()) == [1, 3, 3]
    assert pack(spark, docs.limit(0), SF_DIR).count() == 0
