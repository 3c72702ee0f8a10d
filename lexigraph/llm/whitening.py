"""Whitening of embeddings: principal components scaled to unit variance.

Coordinates become integers, floor(scale * c) + offset, so sums and squared
deviations are exact. Each partition's rows pass through Welford's rank-one
update of a mean and a matrix of centred products; partitions are merged by the
parallel form of the same update, in the partitions' order, first in FAN tasks
and then on the driver, which sees FAN matrices of the vectors' dimension however
many rows there are. The covariance is diagonalised by Householder reflections and
symmetric QR steps with implicit shifts.

Defined results: vectors that are null or hold null or non-finite entries, or ones
beyond LARGEST, whose integers would not be exact, are left out. Vectors all have
one dimension; if not, those of the commonest one (of equally common ones the
larger) are kept and the others left out. An empty vector
has no component and gives no row. Repeated rows count and come back each; a null
id stays null. Components of equal variance are some basis of their space.
A component whose variance is below EPS of the total has no direction to scale:
whitened is 0, and identity_error doesn't count it. deviation is null where it
exceeds a long. No rows give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Tasks in which the partitions' matrices are merged.
FAN = 16
EPS = 1e-13
#: Beyond it scale * c + offset has no exact integer.
LARGEST = float(1 << 42)
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers within LARGEST."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST)
    return vector.isNotNull() & ~F.exists(vector, bad)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): usable vectors of the commonest dimension as integers."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    # One row for each dimension; the commonest is all that comes back.
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return rows.where(F.size("v") == (most["d"] if most else 0)).select("id", F.transform("v", lambda c: (F.floor(c * scale) + offset).cast("long")).alias("x"))


@dataclass
class Moments:
    """Rows seen, their mean, centred products and exact sums."""

    n: int
    mean: np.ndarray
    products: np.ndarray
    sums: np.ndarray

    @staticmethod
    def empty(d: int) -> Moments:
        return Moments(0, np.zeros(d), np.zeros((d, d)), np.zeros(d, np.int64))

    def add(self, x: np.ndarray) -> None:
        """Welford's update: the products grow by a matrix of rank one."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.products += np.outer(before, x - self.mean)

    def merge(self, other: Moments) -> None:
        """The parallel update: what two sets of rows have together."""
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n * (other.n / n))
        self.mean += apart * (other.n / n)
        self.n = n
        self.count(other.sums)

    def count(self, sums: np.ndarray) -> None:
        if np.abs(self.mean).max(initial=0) * self.n > LONG // 2:
            raise OverflowError("the vectors' sums exceed a long")
        self.sums += sums

    def covariance(self) -> np.ndarray:
        m = self.products / max(self.n, 1)
        return (m + m.T) / 2


SCHEMA = "part int, n long, mean array<double>, products array<double>, sums array<long>"


def _batch(part: int, m: Moments | None) -> Iterator[pa.RecordBatch]:
    if m is not None and m.n:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([m.n], pa.int64()), "mean": pa.array([m.mean]), "products": pa.array([m.products.ravel()]), "sums": pa.array([m.sums])})


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one dimension as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _read(b: pa.RecordBatch) -> Iterator[Moments]:
    for i in range(b.num_rows):
        mean = b["mean"][i].values.to_numpy().copy()
        yield Moments(b["n"][i].as_py(), mean, b["products"][i].values.to_numpy().reshape(len(mean), -1).copy(), b["sums"][i].values.to_numpy().copy())


def moments(rows: DataFrame, values, fan: int = FAN) -> Moments | None:
    """Mean and centred products of what values (a function of a batch) makes of
    rows; None if there are none. Sums are of the integer columns x alone."""

    def welford(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = None, 0
        for b in sliced(batches):
            if not b.num_rows:
                continue
            part = b["part"][0].as_py()
            x = values(b)
            seen = seen or Moments.empty(x.shape[1])
            for row in x.astype(np.float64):
                seen.add(row)
            if x.dtype == np.int64:
                seen.count(x.sum(axis=0))
        yield from _batch(part, seen)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = None, 0
        for b in batches:
            for m in _read(b):
                if seen is None:
                    seen, part = m, b["part"][0].as_py()
                else:
                    seen.merge(m)
        yield from _batch(part, seen)

    parts = rows.withColumn("part", F.spark_partition_id()).mapInArrow(lean(welford), SCHEMA)
    # Neighbouring partitions meet in order, so that a rerun adds in the same order.
    merged = parts.repartition(fan, F.pmod("part", F.lit(fan))).sortWithinPartitions("part").mapInArrow(lean(merge), SCHEMA)
    total = None
    for b in merged.toArrow().sort_by("part").to_batches():  # a row for each of fan tasks
        for m in _read(b):
            if total is None:
                total = m
            else:
                total.merge(m)
    return total


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, the entries beside it, and q with a = q t q', by reflections."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns."""
    n = len(a)
    d, e, q = tridiagonal(a)
    vectors = np.ascontiguousarray(q.T)  # rows, which rotations combine
    tiny, hi = np.finfo(float).eps, n - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        # A QR step on rows lo to hi, shifted by the end block's eigenvalue nearest its last entry.
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + (1 if half >= 0 else -1) * np.hypot(half, e[hi - 1]))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, b, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * b + s * s * t, s * s * p - 2 * c * s * b + c * c * t
            e[k] = (c * c - s * s) * b + c * s * (t - p)
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            vectors[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ vectors[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    return d[order], vectors[order].T


@dataclass(frozen=True)
class Whitening:
    """What fit found: a few numbers for each dimension and component."""

    n: int
    sums: np.ndarray  # of each dimension, exact
    values: np.ndarray  # the components' variances, falling
    vectors: np.ndarray  # dimensions x components
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers, whitened."""
        # x - S/n without a rounded mean: whole parts go exactly, the rest is below one.
        whole, rest = np.divmod(self.sums, self.n)
        scaled = np.where(self.values > EPS * self.trace, self.vectors / np.sqrt(np.maximum(self.values, np.finfo(float).tiny)), 0.0)
        return ((x - whole).astype(np.float64) - rest / self.n) @ scaled


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (id, x); None if there are none."""
    m = moments(rows, lambda b: _matrix(b["x"]))
    if m is None:
        return None
    v = m.covariance()
    values, vectors = symmetric_qr(v)
    k = min(components, len(values))
    return Whitening(m.n, m.sums, np.maximum(values[:k], 0.0), vectors[:, :k], float(np.trace(v)))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    m = moments(rows, lambda b: w.apply(_matrix(b["x"])))
    there = w.values > EPS * w.trace
    return float(np.abs(m.covariance() - np.eye(len(there)))[np.ix_(there, there)].max(initial=0.0))


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    """The sum over dimensions of (n * x - sums) ** 2 of each row, exactly."""
    bound = max(n * int(np.abs(x).max(initial=0)), int(np.abs(sums).max(initial=0)))
    if bound <= LONG // 2:
        away = n * x - sums
        if int(np.abs(away).max(initial=0)) ** 2 * max(1, x.shape[1]) <= LONG:
            return (away * away).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [d if d <= LONG else None for d in exact]


def _rows(w: Whitening, error: float):
    k = len(w.values)
    explained = w.values / w.trace if w.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            if not b.num_rows:
                continue
            x = _matrix(b["x"])
            white, m = w.apply(x), b.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": b["id"].take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, w.n, np.int64)),
                    "deviation": pa.array(deviations(x, w.sums, w.n), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
            )

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Returns id_col, component (from 1), n, deviation, whitened, explained and
    identity_error, a row for each usable vector and component."""
    rows = integer_vectors(vectors, id_col, vector_col, scale, offset)
    id_type = dict(rows.dtypes)["id"]
    w = fit(rows, components)
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return rows.mapInArrow(lean(_rows(w, identity_error(rows, w))), schema).withColumnRenamed("id", id_col)
