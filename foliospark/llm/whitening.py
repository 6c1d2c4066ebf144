"""Whitening by an incremental eigendecomposition of the covariance.

Each task keeps the eigendecomposition of the scatter of the rows it has seen and updates it row by
row: the row, centred on the running mean, is a rank-one term; the new eigenvalues are the roots of the
secular equation between the old ones, after components without weight and groups of equal eigenvalues
have been deflated; the eigenvectors follow from weights that are recomputed to fit the roots, which
keeps them orthogonal. The spectra of the tasks are merged in a tree of bounded groups, again by rank-one
updates: one per eigenvector of the other spectrum and one for the difference of the means. One more
distributed pass forms the covariance within that basis (Rayleigh-Ritz), whose eigenvectors are exact to
double precision however the updates rounded. A task holds one d x d basis and a batch of rows; the driver
gets one spectrum, one d x d matrix and one small matrix.

Defined cases. Rows whose vector is null, empty, or holds null, non-finite or absurdly large entries (1024 c
beyond 2**52) take no part, nor do vectors of another length than the most common (ties: the longer). A null
vec_id and repeated rows stay. Directions without variance give no component, so equal vectors, one row or
no row give no rows. Equal eigenvalues share any orthonormal basis. ``deviation`` is null where a long can't hold it.
Other columns don't matter, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import named, stored

SCALE, SHIFT = 1024, 100_000  # fixed values: x = floor(1024 c) + 100000
COMPONENTS = 8
FAN = 16  # spectra or matrices that one task merges, fewer where they are large
CELLS = 1 << 22  # entries of the matrices of one group
EPS = np.finfo(float).eps
SUMS = pa.schema([("place", pa.int32()), ("floats", pa.binary())])
SPECTRA = pa.schema([("place", pa.int32()), ("n", pa.int64()), ("sums", pa.binary()), ("floats", pa.binary())])


# ---------------------------------------------------------------- rank-one updates


def roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - t)) = 0 for rising poles and positive weights.

    There is one root above each pole. Returns the index of the nearest pole and the offset from it, which
    keeps differences between roots and poles exact to the last bits.
    """
    n = len(poles)
    above = np.append(poles[1:], poles[-1] + weights.sum())
    gap = above - poles
    inner = np.arange(n)
    delta = poles[None, :] - poles[:, None]  # row: root, column: pole, relative to the pole below
    middle = 1 + (weights / (delta - gap[:, None] / 2)).sum(1)
    near = np.where((middle >= 0) | (inner == n - 1), inner, np.minimum(inner + 1, n - 1))
    delta = poles[None, :] - poles[near][:, None]
    high = near > inner
    low_at, high_at = np.where(high, -gap / 2, 0.0), np.where(high, 0.0, np.where(inner == n - 1, gap, gap / 2))
    t = (low_at + high_at) / 2
    left, done = delta[inner, inner], np.zeros(n, bool)
    split = np.arange(n)[None, :] <= inner[:, None]
    right = np.where(inner == n - 1, np.inf, delta[inner, np.minimum(inner + 1, n - 1)])
    for _ in range(80):
        term = weights / (delta - t[:, None])
        slope = term / (delta - t[:, None])
        value = 1 + term.sum(1)
        size = 1 + np.abs(term).sum(1)
        done |= np.abs(value) <= 4 * n * EPS * size
        if done.all():
            break
        low_at, high_at = np.where(value < 0, t, low_at), np.where(value < 0, high_at, t)
        # Replace both sums by a + b / (pole - t) with their value and slope, and solve for t.
        below, over = np.where(split, slope, 0).sum(1), np.where(split, 0, slope).sum(1)
        p, q = left - t, np.where(np.isfinite(right), right - t, 1.0)
        b, c = below * p * p, over * q * q
        a = value - below * p - over * q
        a = np.where(np.isfinite(right), a, value - below * p)
        # a + b / (p - s) + c / (q - s) = 0
        A, B, C = a, -(a * (p + q) + b + c), a * p * q + b * q + c * p
        root = np.sqrt(np.maximum(B * B - 4 * A * C, 0))
        w = -0.5 * (B + np.where(B >= 0, root, -root))
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = w / A, C / w
            single = p + b / a
        fits = lambda s: np.isfinite(s) & (t + s > low_at) & (t + s < high_at)
        half = (low_at + high_at) / 2
        step = np.where(fits(one), t + one, np.where(fits(two), t + two, half))
        step = np.where(np.isfinite(right), step, np.where(fits(single), t + single, half))
        new = np.where(done, t, step)
        if (new == t).all() or (high_at - low_at <= EPS * np.maximum(np.abs(low_at), np.abs(high_at)) / 2).all():
            break
        t = new
    # A root that rounds onto its pole would divide by zero; the smallest offset keeps it off.
    tiny = np.finfo(float).tiny
    t = np.where(t == 0, np.where(high, -tiny, tiny), t)
    return near, t


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of basis diag(values) basis' + rho vector vector', rho > 0."""
    z = basis.T @ vector * np.sqrt(rho)
    norm = float(z @ z)
    if norm == 0 or not np.isfinite(norm):
        return values, basis
    tolerance = 8 * EPS * max(abs(values[-1]), abs(values[0]), norm)
    # Deflation 1: rotate each group of equal eigenvalues so that one direction carries its weight.
    starts = np.flatnonzero(np.append(True, np.diff(values) > tolerance))
    ends = np.append(starts[1:], len(values))
    for a, b in zip(starts, ends):
        if b - a > 1:
            part = z[a:b]
            length = np.sqrt(part @ part)
            if length > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(length, part[-1])
                square = mirror @ mirror
                if square > 0:
                    basis[:, a:b] -= np.outer(basis[:, a:b] @ mirror, 2 / square * mirror)
                    z[a : b - 1], z[b - 1] = 0.0, -np.copysign(length, part[-1])
    # Deflation 2: directions without weight keep their eigenvalue.
    live = np.flatnonzero(z * z > tolerance * EPS) if norm * EPS > 0 else np.flatnonzero(z)
    live = live[np.abs(z[live]) * np.sqrt(norm) > tolerance]
    if not len(live):
        return values, basis
    poles, weight = values[live], z[live]
    if len(live) == 1:
        out, turned = poles + weight * weight, np.ones((1, 1))
    else:
        near, offset = roots(poles, weight * weight)
        # pole - root, through the nearest pole
        apart = (poles[:, None] - poles[near][None, :]) - offset[None, :]
        # Weights for which these roots are exact (Loewner): orthogonal eigenvectors even for close roots.
        ratio = -apart / np.where(np.eye(len(live), dtype=bool), 1.0, poles[None, :] - poles[:, None])
        fitted = np.sqrt(np.abs(np.prod(ratio, axis=1)))
        turned = np.copysign(fitted, weight)[:, None] / apart
        turned /= np.sqrt((turned * turned).sum(0))
        out = poles[near] + offset
    values = values.copy()
    values[live] = out
    basis[:, live] = basis[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Number of rows, exact sums, mean, and the eigendecomposition of the centred scatter."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean = 0, np.zeros(d, np.int64), np.zeros(d)
        self.values, self.basis = np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray) -> None:
        """One row of whole numbers."""
        off = x - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, off, self.n / (self.n + 1))
        self.n += 1
        self.sums += x
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        off = other.mean - self.mean
        share = self.n * other.n / (self.n + other.n)
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, float(value))
        if share:
            self.values, self.basis = rank_one(self.values, self.basis, off, share)
        self.mean = self.mean + off * (other.n / (self.n + other.n))
        self.n, self.sums = self.n + other.n, self.sums + other.sums

    def row(self, place: int) -> dict:
        return {"place": place, "n": self.n, "sums": self.sums.tobytes(), "floats": np.concatenate([self.mean, self.values, self.basis.ravel()]).tobytes()}

    @classmethod
    def of(cls, n: int, sums: bytes, floats: bytes) -> Spectrum:
        whole, data = np.frombuffer(sums, np.int64), np.frombuffer(floats)
        d = len(whole)
        out = cls(d)
        out.n, out.sums, out.mean, out.values, out.basis = int(n), whole.copy(), data[:d].copy(), data[d : 2 * d].copy(), data[2 * d :].reshape(d, d).copy()
        return out


# ---------------------------------------------------------------- passes over the rows


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that take part, their entries as whole numbers."""
    entries = F.transform(named("embedding"), lambda c: c.cast("double") * SCALE)
    # NaN is larger than any number here, so one comparison finds it and the infinities too.
    fine = F.forall("scaled", lambda c: F.coalesce(F.abs(c) <= F.lit(float(1 << 52)), F.lit(False)))
    rows = vectors.select(named("vec_id").alias("vec_id"), entries.alias("scaled")).where(F.col("scaled").isNotNull() & (F.size("scaled") > 0)).where(fine)
    return rows.select("vec_id", F.transform("scaled", lambda c: F.floor(c).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def spectra(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    own = Spectrum(d)
    for batch in batches:
        for x in matrix(batch.column(0), d):
            own.add(x)
    if own.n:
        yield pa.RecordBatch.from_pylist([own.row(TaskContext.get().partitionId())], SPECTRA)


def merged(rows: DataFrame, parts: int, d: int, join: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Merge rows (place, ...) in groups of neighbouring places until one is left."""
    fan = max(2, min(FAN, CELLS // (d * d)))
    while parts > 1:
        rows = rows.withColumn("place", F.floor(F.col("place") / fan).cast("int"))
        rows = rows.groupBy("place").applyInPandas(join, rows.schema)
        parts = -(-parts // fan)
    return rows


def join_spectra(group: pd.DataFrame) -> pd.DataFrame:
    own = None
    for r in group.sort_values("n", ascending=False, kind="stable").itertuples():
        other = Spectrum.of(r.n, r.sums, r.floats)
        if own is None:
            own = other
        else:
            own.merge(other)
    return pd.DataFrame([own.row(int(group["place"].iat[0]))])


def join_sums(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b) for b in group["floats"])
    return pd.DataFrame([{"place": int(group["place"].iat[0]), "floats": total.tobytes()}])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: as longs where they fit, else as Python's whole numbers."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def moments(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sum of the products of the centred rows in a basis, one matrix per task."""
    total = np.zeros((basis.shape[1],) * 2)
    for batch in batches:
        z = (centred(matrix(batch.column(0), len(sums)), n, sums) / n).astype(float) @ basis
        total += z.T @ z
    yield pa.RecordBatch.from_pylist([{"place": TaskContext.get().partitionId(), "floats": total.tobytes()}], SUMS)


def squares(exact: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row, null beyond a long."""
    most = float(np.abs(exact.astype(float)).max(initial=0))
    if most * most * exact.shape[1] < 2.0**62:
        return (exact * exact).sum(1).tolist()
    sums = [sum(v * v for v in row) for row in exact.astype(object)]
    return [s if s < 1 << 63 else None for s in sums]


def rows_out(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    k = axes.shape[1]
    for batch in batches:
        exact = centred(matrix(batch.column(1), len(sums)), n, sums)
        white = (exact / n).astype(float) @ axes
        rows = len(white)
        yield pa.record_batch(
            [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                pa.array([s for s in squares(exact) for _ in range(k)], pa.int64()), pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that takes part."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    out = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], out)
    d = lengths["d"]
    rows = rows.where(F.size("x") == d)
    narrow = rows.select("x")
    parts = max(1, narrow.rdd.getNumPartitions())
    shape = "place int, n long, sums binary, floats binary"
    got = merged(narrow.mapInArrow(lambda b: spectra(b, d), shape), parts, d, join_spectra).first()
    whole = Spectrum.of(got.n, got.sums, got.floats)
    n, sums = whole.n, whole.sums

    def covariance(basis: np.ndarray) -> np.ndarray:
        made = narrow.mapInArrow(lambda b: moments(b, n, sums, basis), "place int, floats binary")
        return np.frombuffer(merged(made, parts, d, join_sums).first().floats).reshape(basis.shape[1], -1) / n

    within = covariance(whole.basis)
    values, turned = np.linalg.eigh((within + within.T) / 2)
    trace = float(np.trace(within))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > d * EPS * trace]
    if not len(order):
        return spark.createDataFrame([], out)
    axes = whole.basis @ turned[:, order]
    axes = axes / np.sqrt((axes * axes).sum(0)) / np.sqrt(values[order])
    error = float(np.abs(covariance(axes) - np.eye(len(order))).max())
    explained = values[order] / trace
    return rows.mapInArrow(lambda b: rows_out(b, n, sums, axes, explained, error), out)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
