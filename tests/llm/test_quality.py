"""Quality classifier: held-out accuracy, no leak from held-out labels, defined edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import additive_model as A
from tidebook.llm import quality as Q

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int"


def area(score, label):
    """Chance that a row of label 1 scores above a row of label 0."""
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(len(score))
    pos = label == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy_and_columns(spark, middle):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{middle}/labels.parquet").collect()}
    rows = Q.op3_quality(spark, middle).collect()
    assert len(rows) == spark.read.parquet(f"{middle}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    score, label = np.array([s for s, _ in held]), np.array([y for _, y in held])
    assert area(score, label) > 0.9


def test_held_out_labels_are_never_learned(spark, middle):
    docs, labels = spark.read.parquet(f"{middle}/documents.parquet"), spark.read.parquet(f"{middle}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(Q.remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = Q.train(docs, labels), Q.train(docs, flipped)
    x = np.random.default_rng(1).random((50, len(Q.FEATURES)))
    assert np.array_equal(one.score(x), two.score(x))


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells anything
    model = A.fit(x[:3000], y[:3000])
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_additive_model_without_two_classes(y):
    score = A.fit(np.zeros((len(y), 2)), np.array(y)).score(np.zeros((1, 2)))[0]
    assert score == pytest.approx((sum(y) + 1) / (len(y) + 2))


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "x" * 1_000_000), (None, "words"), (4, "same"), (4, "same")]
    docs = spark.createDataFrame([(*t, 9, "z") for t in texts], f"{DOCS}, score int, r string")
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (4, 1), (77, 0)], LABELS)
    model = Q.train(docs, labels)
    rows = Q.annotate(docs, model).collect()
    assert len(rows) == 6 and all(r.score == 9 and r.r == "z" and 0 <= r.quality_score.score <= 1 for r in rows)
    by_id = [r.quality_score.score for r in rows if r.doc_id in (1, 2)]
    assert by_id[0] == by_id[1]
    nothing = Q.train(docs, spark.createDataFrame([], LABELS))
    assert {r.quality_score.score for r in Q.annotate(docs, nothing).collect()} == {0.5}
    assert Q.annotate(spark.createDataFrame([], DOCS), nothing).count() == 0
