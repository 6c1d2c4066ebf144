"""Neighbours against brute force: exact with all candidates, recall with the forest's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import ann as m


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            scores = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), scores[j]) for j in order]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 8)).astype(np.float32)
    x[40:90] = x[40]  # one vector many times
    x[100] = x[101] * 3
    return np.arange(260), x.astype(float)


def test_all_candidates_is_exact(spark, vectors):
    ids, x = vectors
    rows = [(int(i), [float(v) for v in q], "c") for i, q in zip(ids, x)]
    bad = [(None, [1.0] * 8, "c"), (1000, None, "c"), (1020, [], "c"), (1040, [0.0] * 8, "c"), (1060, [1.0, None] + [0.0] * 6, "c"), (1080, [float("nan")] * 8, "c"),
           (1100, [float("inf")] * 8, "c"), (1120, [1.0], "c")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in m.neighbours(table, F.col("vec_id") % 20 == 0, share=1.0, shard=64, block=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(ids, x, m.K)
    assert set(got) == set(want)
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, m.K + 1))
        assert [v for _, v, _ in own] == [v for v, _ in want[q]]
        assert np.allclose([s for _, _, s in own], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = table.toPandas().sort_values("vec_id")
    want = brute(data["vec_id"].to_numpy(), np.array(data["embedding"].tolist(), float), m.K)
    rows = m.op4_neighbours(spark, "/root/testdata/sf0.01").collect()
    found = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in rows)
    assert len(rows) == m.K * len(want) and found / len(rows) >= 0.9


def test_ascent_reaches_the_longest_prefixes_first():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    forest = m.Forest(x, float(np.linalg.norm(x, axis=1).max()), trees=4, bits=16)
    q = rng.normal(size=(3, 6))
    low, high = forest.ranges(forest.strings(np.concatenate([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((3, 1))], 1)))
    assert (low[:, :, 0] == 0).all() and (high[:, :, 0] == 500).all() and ((high - low)[:, :, :-1] >= (high - low)[:, :, 1:]).all()
    marks = forest.candidates(q, 60)
    assert (marks.sum(1) >= 60).all() and marks.sum(1).max() < 500
    assert forest.candidates(q, 500).all()


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    rows = m.neighbours(table, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 1, 0.5)]
    assert m.neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert m.neighbours(table.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0
