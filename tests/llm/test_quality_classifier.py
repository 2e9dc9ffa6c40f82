"""The discriminant against closed-form densities, held-out accuracy, and odd rows."""

import zlib

import numpy as np

from tidewell.llm.common import load
from tidewell.llm.quality_classifier import FEATURES, Shrinkage, features, fit, keep_good, quality_scores

SF = "/root/testdata/sf0.01"


def test_fit_against_numpy():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (400, 5)) @ rng.normal(0, 1, (5, 5)), rng.normal(1, 2, (300, 5))]
    counts = np.array([len(a) for a in x], float)
    sums, products = np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x])
    model = fit(counts, sums, products, Shrinkage(0, 0, 0, 1.0))
    probe = rng.normal(0, 2, (50, 5))
    logs = []
    for a in x:
        c, d = np.cov(a.T, bias=True), probe - a.mean(0)
        logs.append(np.log(len(a) / counts.sum()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.scores(probe), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))
    assert fit(np.array([3.0, 0.0]), sums, products) is None


def test_constant_features_do_not_break():
    model = fit(np.array([4.0, 4.0]), np.zeros((2, 3)), np.zeros((2, 3, 3)))
    assert np.allclose(model.scores(np.zeros((2, 3))), 0.5)


def test_held_out_accuracy(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.97
    # held-out labels don't matter
    again = quality_scores(docs, labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) quality", "toxic"))
    assert {r.doc_id: r.score for r in again.collect()} == {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, quality int"
    rows = [(1, None, None, None, None, "x", 7), (2, "", None, None, None, "x", 7), (None, "some text", None, None, None, "x", 7), (4, "word " * 100000, None, None, None, "x", 7), (4, "word " * 100000, None, None, None, "x", 7), (5, "a퟿b \x00 é", None, None, None, "x", 7)]
    docs = spark.createDataFrame(rows, schema)
    labels = load(spark, SF, "labels")
    out = quality_scores(docs.unionByName(load(spark, SF, "documents").selectExpr("*", "'' score", "1 quality")), labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows) + 1000
    none = labels.limit(0)
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 0), (1, 3, 0)], "doc_id long, quality int, toxic int")
    assert quality_scores(docs, nulls).count() == len(rows)
    assert quality_scores(docs.limit(0), labels).count() == 0
    kept = keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_features_are_finite():
    for text in ["", " ", "\n", "x", "!!!", "1\n1\n1", "é" * 100000, None]:
        f = features(text)
        assert len(f) == len(FEATURES) and np.isfinite(f).all()
