"""The classifier on held-out rows, and its defined cases."""

import math
import zlib

import numpy as np
import pytest

from foliospark.llm import quality as m


@pytest.fixture(scope="module")
def small_tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark, small_tables):
    docs, labels = small_tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = m.scored(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(own) > 50 and np.mean([p == t for p, t in own]) > 0.97


def test_held_out_labels_change_nothing(spark, small_tables):
    from pyspark.sql import functions as F

    docs, labels = small_tables
    turned = labels.withColumn("quality", F.when(m.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    some = docs.limit(50)
    one = {r.doc_id: r.score for r in some.select("doc_id", m.scorer(spark, m.model(docs, labels))("text").alias("score")).collect()}
    two = {r.doc_id: r.score for r in some.select("doc_id", m.scorer(spark, m.model(docs, turned))("text").alias("score")).collect()}
    assert one == two


def test_scores_are_sparse_dot_products():
    rng, own = np.random.default_rng(0), m.Featurizer()
    w = rng.normal(size=(1 << m.BITS) + 1).astype(np.float32)
    for text in ["", "  ", "one", "One, two &&& TWO two", "é " * 3000]:
        (slots, values), = own.vectors([text])
        arrays, counts = own.slots([text])
        direct = sum(w[a].astype(float).sum() for a in arrays) * m.SCALE / counts[0]
        assert math.isclose(direct, float((w[slots] * values).sum()), rel_tol=1e-3, abs_tol=1e-3)


def test_updates_separate_two_classes():
    rows = [(np.array([1, 2]), np.array([1.0, 1.0], np.float32), 1), (np.array([2, 3]), np.array([1.0, 1.0], np.float32), 0)] * 50
    w = m.train_shard(rows, 4, 0)
    assert w[1] > 0.5 and w[3] < -0.5


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, "good text", "a"), (1, "good text", "a"), (None, "x", "b"), (4, None, None), (5, "", "c"), (6, "word " * 30000, "d")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    rows = m.scored(docs, labels).collect()
    assert len(rows) == 6 and all(r.score == 0.5 for r in rows)
    assert m.scored(docs.limit(0), labels).count() == 0 and m.scored(docs, labels.limit(0)).count() == 6
    mixed = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    again = m.scored(docs, mixed).collect()
    assert len({r.score for r in again if r.doc_id == 1}) == 1 and {r.doc_id for r in again} == {1, None, 4, 5, 6}
    assert all(r.held_out is False for r in again if r.doc_id is None)
