"""Memberships and rates against numpy."""

import numpy as np
import pytest

from foliospark.llm import mixing as m


def table(spark, n=60):
    words = {0: "bad poor", 1: "bad nasty", 2: "fine good", 3: "fine nasty"}
    rows, labels = [], []
    for i in range(n):
        d = i % 4
        rows.append((i, " ".join([words[d]] * (1 + i % 5)) + f" filler{i % 7}"))
        if i % 3:
            labels.append((i, d // 2, d % 2))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = table(spark)
    docs = spark.createDataFrame(rows + [(100, None), (101, ""), (102, "fine good"), (102, "fine good"), (None, "bad poor")], "doc_id long, text string")
    got = m.mixed(docs, spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int"))
    return len(rows) + 5, got.collect()


def solved(p, n, share, steps=4000):
    """The same objective by plain projected gradients in numpy."""
    total = n.sum()
    have = (p * n[:, None]).sum(0) / total
    scale, t, r = np.maximum(have, m.LEAST), np.array([m.TARGETS[d] * m.BUDGET for d in m.DOMAINS]), np.ones(len(n))
    for _ in range(steps):
        a = (p * (n * r)[:, None]).sum(0) / total
        r = np.maximum(0, r - (p @ ((a - t) / scale) + m.LAMBDA * (r - 1)) / (1 + m.LAMBDA))
    return r


def test_rows_and_memberships(fitted):
    n, rows = fitted
    assert len(rows) == n and sum(r.doc_id == 102 for r in rows) == 2
    names = [f"p_{d}" for d in m.DOMAINS]
    assert all(abs(sum(r[c] for c in names) - 1) < 1e-9 and r.rate >= 0 for r in rows)
    own = {r.doc_id: r for r in rows}
    assert all(max(names, key=lambda c: own[i][c]) == names[i % 4] for i in range(60))
    assert own[100].tokens == own[101].tokens == 0 and own[102].tokens == 2
    assert own[100]["p_good"] == own[101]["p_good"]


def test_rates_solve_the_least_squares(fitted):
    _, rows = fitted
    p, n = np.array([[r[f"p_{d}"] for d in m.DOMAINS] for r in rows]), np.array([float(r.tokens) for r in rows])
    rates = np.array([r.rate for r in rows])
    got = (p * (n * rates)[:, None]).sum(0) / n.sum()
    best = solved(p, n, None)
    want = (p * (n * best)[:, None]).sum(0) / n.sum()
    assert np.abs(got - want).max() < 0.02
    assert np.abs(got - [m.TARGETS[d] for d in m.DOMAINS]).max() < 0.03


def test_no_python_in_the_plan(spark, fitted):
    rows, labels = table(spark, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = m.memberships(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "clash"), (2, None, None)], "doc_id long, text string, rate string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = m.mixed(docs, none).collect()
    assert len(rows) == 2 and all(abs(r.p_good - 0.25) < 1e-9 for r in rows)
    assert m.mixed(docs.limit(0), none).count() == 0


def test_tokens(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None,), ("",), (" \n",), ("a",), (" a  b\tc\n",)], "t string")
    assert [r[0] for r in df.select(F.size(m.words(F.col("t")))).collect()] == [0, 0, 0, 1, 3]
