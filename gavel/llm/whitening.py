"""Whitening of embeddings: a distributed covariance, its leading eigenvectors by
tridiagonalisation, and a projection of every row.

1. Sums of each dimension, exact for whole numbers; then the covariance, each task
   centring its rows before it multiplies them.  A task sends one value for each
   pair of dimensions; those are added up by a shuffle.
2. On the driver, whose share is bounded by ``MAX_DIMS`` squared whatever the number
   of rows: Householder reflections to a tridiagonal matrix, bisection on Sturm counts
   for the greatest eigenvalues, inverse iteration for their vectors, which are made
   orthogonal within clusters of close eigenvalues.
3. The components go to all tasks, which project their rows.

Rows count only if their vector has no null, no NaN and no infinite entry, at least one
entry, and the commonest length (ties: the greater one); others are dropped.  Repeated
rows count each.  Components whose eigenvalue is not above ``FLOOR`` of the trace have
no scale to divide by and are left out, so that equal vectors, or none, give no
components.  The sign of a component is that which makes its largest entry positive.
Columns named as the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replace_columns

#: Most dimensions: the covariance of so many is 128 MB.
MAX_DIMS = 4096
#: Share of the trace below which an eigenvalue counts as none.
FLOOR = 1e-13
#: Rows that a task multiplies at a time.
ROWS = 8192
EPS = np.finfo(float).eps


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflectors (unit vectors as columns) of a symmetric matrix."""
    a, n = v.astype(float), len(v)
    reflectors = np.zeros((n, max(n - 2, 0)))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).max():
            continue
        u = x / scale
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        u /= np.linalg.norm(u)
        reflectors[k + 1 :, k] = u
        block = a[k + 1 :, k + 1 :]
        p = block @ u
        w = p - (u @ p) * u
        block -= 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * (u @ x) * u
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: for each of ``at`` the number of eigenvalues below it."""
    tiny = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0)) * EPS**2 + np.finfo(float).tiny
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def greatest(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, by bisection from Gershgorin's bounds."""
    n = len(d)
    reach = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    wanted = n - np.arange(1, k + 1)  # so many eigenvalues are below the one sought
    while True:
        mid = low + (high - low) / 2
        if not ((low < mid) & (mid < high)).any():
            return mid
        over = below(d, e, mid) > wanted
        high, low = np.where(over, mid, high), np.where(over, low, mid)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) x = b`` by elimination with row exchanges; pivots are ``least`` at least."""
    n = len(d)
    x = b.copy()
    p, r, s = d - shift, np.append(e, 0.0), np.zeros(n)  # diagonal, first and second above it
    for i in range(n - 1):
        under = e[i]
        if abs(under) > abs(p[i]):
            p[i], under = under, p[i]
            r[i], p[i + 1] = p[i + 1], r[i]
            if i + 1 < n - 1:
                s[i], r[i + 1] = r[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(p[i]) < least:
            p[i] = np.copysign(least, p[i])
        f = under / p[i]
        p[i + 1] -= f * r[i]
        r[i + 1] -= f * s[i]
        x[i + 1] -= f * x[i]
    if abs(p[-1]) < least:
        p[-1] = np.copysign(least, p[-1])
    for i in range(n - 1, -1, -1):
        more = (r[i] * x[i + 1] if i + 1 < n else 0) + (s[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = (x[i] - more) / p[i]
    return x


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors as columns, by inverse iteration; those of a cluster are made orthogonal in each step."""
    n, size = len(d), max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(float).tiny)
    out, start = np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            start = j
        # Equal eigenvalues are set apart by a few units in the last place, else all would find one vector.
        shift = value - (j - start) * 4 * EPS * size
        x = np.random.default_rng(j).standard_normal(n)
        for _ in range(6):
            x /= np.abs(x).max()
            x = _solve(d, e, shift, x, EPS * size)
            for _ in range(2):
                x -= out[:, start:j] @ (out[:, start:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def eigen(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    k = min(k, len(v))
    size = np.abs(v).max(initial=0)
    if not k or not size:
        return np.zeros(k), np.eye(len(v))[:, :k]
    d, e, reflectors = tridiagonal(v / size)
    values = greatest(d, e, k)
    x = vectors(d, e, values)
    for i in range(reflectors.shape[1] - 1, -1, -1):
        u = reflectors[:, i]
        x -= 2 * np.outer(u, u @ x)
    x /= np.linalg.norm(x, axis=0)
    return values * size, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(k)] < 0, -1, 1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """``n * x - sums`` in whole numbers where they are whole and fit, else ``x - sums / n`` times n."""
    if x.dtype.kind == "i":
        if n * max(int(np.abs(x).max(initial=0)), 1) < 2**61:
            return x * n - np.array(sums, np.int64)
        return x.astype(object) * n - np.array(sums, object)
    return (x - np.array([s / n for s in sums], float)) * n


@dataclass
class Whitening:
    """Fitted whitening: ``n`` rows, ``sums`` of each dimension, ``components`` as columns."""

    vector: str
    n: int
    sums: list
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def project(self, df: DataFrame) -> DataFrame:
        """Adds ``whitened`` (an array with a number for each component) and, for whole
        numbers, ``deviation``, the exact sum of ``(n * x - sum)`` squared over the
        dimensions (null where it is beyond a long)."""
        rows = _usable(df, self.vector, len(self.sums))
        if not self.n:
            rows = rows.where("false")
        n, sums, vector = self.n, self.sums, self.vector
        whole = _whole(df, vector)
        scale = self.components / np.sqrt(self.values) / max(n, 1)
        new = {"whitened": T.ArrayType(T.DoubleType())} | ({"deviation": T.LongType()} if whole else {})
        out = T.StructType([f for f in rows.schema.fields if f.name not in new] + [T.StructField(k, t) for k, t in new.items()])

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    part = batch.slice(low, ROWS)
                    d = _centred(_matrix(part.column(vector), len(sums)), n, sums)
                    z = d.astype(float) @ scale
                    more = {"whitened": pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], z.ravel())}
                    if whole:
                        most = int(np.abs(d).max(initial=0))
                        exact = d if d.dtype != object and most**2 * d.shape[1] < 2**63 else d.astype(object)
                        more["deviation"] = pa.array([x if x < 2**63 else None for x in (exact * exact).sum(axis=1).tolist()], pa.int64())
                    yield replace_columns(part, [], **more)

        return rows.mapInArrow(project, out)

    def identity_error(self, df: DataFrame) -> float | None:
        """Largest absolute entry of the covariance of the whitened rows minus the identity, from the rows themselves."""
        k = len(self.values)
        if not self.n or not k:
            return None

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for batch in batches:
                z = _matrix(batch.column("whitened"), k)
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
            yield _entries(total)

        # The rows are centred already (by sums / n); what is left of their mean is rounding.
        m = _added(self.project(df.select(self.vector)).select("whitened").mapInArrow(moments, ENTRIES), (k + 1, k)) / self.n
        return float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())


ENTRIES = "at int, value double"


def _entries(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "value"])


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums of the tasks' entries; the driver gets one for each place."""
    out = np.zeros(shape[0] * shape[1])
    for at, value in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[at] = value
    return out.reshape(shape)


def _whole(df: DataFrame, vector: str) -> bool:
    return isinstance(df.schema[vector].dataType.elementType, T.IntegralType)


def _finite(df: DataFrame, vector: str) -> DataFrame:
    kind = "array<bigint>" if _whole(df, vector) else "array<double>"
    x = F.col(vector).cast(kind)
    bad = (lambda c: c.isNull()) if kind == "array<bigint>" else (lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.withColumn(vector, x).where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(~F.exists(vector, bad))


def _usable(df: DataFrame, vector: str, dims: int) -> DataFrame:
    return _finite(df, vector).where(F.size(vector) == dims)


def fit(df: DataFrame, vector: str = "embedding", k: int = 8) -> Whitening:
    """Fits whitening by the ``k`` leading components of the covariance (divisor n) of all usable rows."""
    whole = _whole(df, vector)
    sized = _finite(df, vector).groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sized is None:
        return Whitening(vector, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    dims, n = sized
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS}")
    rows = _usable(df, vector, dims).select(vector)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(vector), dims)
            total = [sum(c) for c in x.T.tolist()] if whole else x.sum(axis=0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array([str(t) for t in total])], names=["at", "value"])

    kind = "decimal(38,0)" if whole else "double"
    found = dict(rows.mapInArrow(sums, "at int, value string").groupBy("at").agg(F.sum(F.col("value").cast(kind))).collect())
    total = [int(found[i]) if whole else float(found[i]) for i in range(dims)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((dims, dims))
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                x = _centred(_matrix(batch.slice(low, ROWS).column(vector), dims), n, total).astype(float) / n
                m += x.T @ x
        yield _entries(m)

    v = _added(rows.mapInArrow(products, ENTRIES), (dims, dims)) / n
    v = (v + v.T) / 2
    values, components = eigen(v, k)
    trace = float(np.trace(v))
    good = values > FLOOR * trace
    return Whitening(vector, n, total, components[:, good], values[good], trace)
