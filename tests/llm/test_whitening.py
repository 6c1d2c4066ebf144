"""Whitening against numpy's eigendecomposition and Python's whole numbers; the rank-one updates by themselves."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import whitening as m

SCHEMA = "vec_id long, embedding array<float>, x string, n int, place string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)


def whole(vectors):
    """x of each vector, as Python computes it from floats of 32 bits."""
    short = lambda c: struct.unpack("f", struct.pack("f", c))[0]
    return [[math.floor(1024 * short(c)) + 100000 for c in v] for v in vectors]


def compare(got, ids, vectors, components=8):
    x = whole(vectors)
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    exact = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    order = order[values[order] > d * m.EPS * values.sum()]
    assert len(got) == n * len(order)
    assert {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.identity_error <= 1e-6
    assert sorted(by) == list(range(1, len(order) + 1))
    for k, j in enumerate(order, 1):
        own = by[k]
        assert sorted((str(r.vec_id), r.deviation) for r in own) == sorted((str(i), e) for i, e in zip(ids, exact))
        assert all(math.isclose(r.explained, values[j] / values.sum(), rel_tol=1e-10) for r in own)
        apart = min(abs(values[j] - v) for i, v in enumerate(values) if i != j) if d > 1 else 1
        if apart > 1e-6 * values.max():  # else any basis of the shared space will do
            want = centred @ axes[:, j] / np.sqrt(values[j])
            best = {}
            for i, v in zip(ids, want):
                best.setdefault(str(i), []).append(v)
            have = {}
            for r in own:
                have.setdefault(str(r.vec_id), []).append(r.whitened)
            first = max(best, key=lambda i: abs(best[i][0]) if len(best[i]) == 1 else 0)
            sign = np.sign(best[first][0] * have[first][0])
            for i in best:
                assert np.allclose(sorted(sign * np.array(have[i])), sorted(best[i]), atol=1e-7)


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 12)) * np.linspace(0.1, 1, 12)
    v[100:400] = v[100]  # one vector in many rows
    ids = list(range(700))
    for parts in (1, 3, 40):
        compare(m.whiten(table(spark, list(zip(ids, v.tolist()))).repartition(parts)).collect(), ids, v)


def test_rows_that_take_no_part(spark):
    good = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [0.125, 0.75]), (3, [1.0, 1.0])]
    bad = [(4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [-float("inf"), 1.0]), (10, [1.0]), (11, [3e38, 1.0]), (12, [1.0, 2.0, 3.0])]
    got = m.whiten(table(spark, good + bad)).collect()
    compare(got, [i for i, _ in good], [v for _, v in good])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(i, [0.5, 0.25]) for i in range(9)]])
def test_nothing_to_whiten(spark, rows):
    got = m.whiten(table(spark, rows))
    assert got.collect() == []
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_eigenvalues_and_missing_directions(spark):
    corners = [(i, [1.0 if j == i % 4 else 0.0 for j in range(4)] + [0.5, 0.5]) for i in range(40)]
    got = m.whiten(table(spark, corners)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    compare(got, [i for i, _ in corners], [v for _, v in corners])


def test_one_dimension(spark):
    rows = [(i, [float(i % 5)]) for i in range(20)]
    compare(m.whiten(table(spark, rows)).collect(), [i for i, _ in rows], [v for _, v in rows])


def test_exact_beyond_machine_words():
    x = np.array([[1 << 50, -(1 << 50)], [5, 7]], np.int64)
    out = m.centred(x, 1 << 20, np.array([1, 2], np.int64))
    assert out.tolist() == [[(1 << 70) - 1, -(1 << 70) - 2], [5 * (1 << 20) - 1, 7 * (1 << 20) - 2]]
    assert m.squares(out) == [None, (5 * (1 << 20) - 1) ** 2 + (7 * (1 << 20) - 2) ** 2]


def fits(scatter, values, basis):
    size = max(np.abs(scatter).max(), 1e-300)
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-11
    assert np.abs(basis @ np.diag(values) @ basis.T - scatter).max() < 1e-11 * size
    assert (np.diff(values) >= -1e-12 * size).all()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 7), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([0, 1, 2, 1000, 10**7]))
def test_updates(d, n, seed, spread):
    """Few different values make equal eigenvalues, zero weights and repeated rows."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, size=(n, d))
    one, two = m.Spectrum(d), m.Spectrum(d)
    cut = int(rng.integers(0, n + 1))
    for row in x[:cut]:
        one.add(row)
    for row in x[cut:]:
        two.add(row)
    for part, own in ((x[:cut], one), (x[cut:], two)):
        if len(part):
            off = part - part.mean(0)
            fits(off.T @ off, own.values, own.basis)
    if cut:
        one.merge(two)
    else:
        one = two
    off = x - x.mean(0)
    fits(off.T @ off, one.values, one.basis)
    assert one.n == n and one.sums.tolist() == x.sum(0).tolist()


def test_graded_spectrum():
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(400, 30)) * np.logspace(0, 7, 30)).astype(np.int64)
    own = m.Spectrum(30)
    for row in v:
        own.add(row)
    off = v - v.mean(0)
    fits(off.T @ off, own.values, own.basis)


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    compare(m.op12_whitening(spark, small).collect(), [r.vec_id for r in rows], [list(r.embedding) for r in rows])
