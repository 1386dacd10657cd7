"""Whitening of embeddings: Welford updates, merged states, a symmetric QR eigen-solve.

Every task streams its vectors through rank-one updates of (n, mean, M), M being the
sum of centred products, and of the exact integer sums.  The states of the
partitions are merged by the parallel update formula, FAN of them at a time, so neither
a task nor the driver gets more than FAN states of d * d numbers.  The covariance of
d * d numbers is reduced to tridiagonal form by reflections and solved by QR steps
with Wilkinson's shift.  A second pass measures the covariance of the whitened
values in the same way; a third writes them.

Components are numbered by falling eigenvalue and point so that their largest entry
is positive.

Defined results: vectors that are null or hold nulls or non-finite numbers give no row
and teach nothing; of vectors of several lengths those of the commonest one count (the
longer of equally common ones); a component of 65,536 or more in size is an error; a component
whose eigenvalue is at the level of rounding (1e-12 of the trace or less: constant
columns, fewer rows than dimensions) has whitened 0 and stays out of identity_error; where all
vectors are equal `explained` is 0; rows that repeat count as often as they stand; a
null id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, session
from .states import fold_states
from .vectors import kept, matrices

OFFSET = 100_000
FAN = 64
ROUNDING = 1e-12
_STATE = "part long, n long, sums array<long>, mean binary, m binary"


class Welford:
    """Number, mean and centred products of the vectors seen."""

    def __init__(self, dims: int):
        self.n, self.mean, self.m = 0, np.zeros(dims), np.zeros((dims, dims))
        self._buffer = np.empty((dims, dims))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update for each row."""
        mean, m, buffer, n = self.mean, self.m, self._buffer, self.n
        for x in rows:
            n += 1
            before = x - mean
            mean += before / n
            m += np.multiply.outer(before, x - mean, out=buffer)
        self.n = n

    def merge(self, n: int, mean: np.ndarray, m: np.ndarray) -> None:
        """The parallel update formula."""
        if not n:
            return
        total, apart = self.n + n, mean - self.mean
        self.m += m + np.outer(apart, apart) * (self.n * n / total)
        self.mean += apart * (n / total)
        self.n = total

    def covariance(self) -> np.ndarray:
        return (self.m + self.m.T) / (2 * self.n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q', by reflections."""
    a, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, by shifted QR steps."""
    d, e, q = tridiagonal(a)
    eps, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[-1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2  # Wilkinson's shift
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # the bulge is chased down by rotations
            r = np.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, o, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p - 2 * c * s * o + s * s * t, s * s * p + 2 * c * s * o + c * c * t
            e[k] = c * s * (p - t) + (c * c - s * s) * o
            if k + 1 < hi:
                z, e[k + 1] = -s * e[k + 1], c * e[k + 1]
            x = e[k]
            left, right = q[:, k].copy(), q[:, k + 1].copy()
            q[:, k], q[:, k + 1] = c * left - s * right, s * left + c * right
    order = np.argsort(-d, kind="stable")
    q = q[:, order]
    top = np.abs(q).argmax(0)
    return d[order], q * np.where(q[top, np.arange(len(d))] < 0, -1.0, 1.0)


def _state(n: int, sums: list[int], w: Welford) -> dict:
    return {"n": n, "sums": sums, "mean": w.mean.tobytes(), "m": w.m.tobytes()}


def _merged(states: list[dict], dims: int) -> tuple[list[int], Welford]:
    w, sums = Welford(dims), [0] * dims
    for r in states:
        w.merge(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m"]).reshape(dims, dims))
        sums = [a + b for a, b in zip(sums, r["sums"])]
    return sums, w


def accumulate(scratch: Scratch, rows: DataFrame, read, dims: int, name: str) -> tuple[list[int], Welford]:
    """(exact sums, state) of all rows; read(batches) yields (integer rows, float rows) of `dims` columns."""

    def stream(batches):
        w, sums = Welford(dims), [0] * dims
        for whole, x in read(batches):
            w.add(x)
            sums = [a + int(b) for a, b in zip(sums, whole.sum(0))]
        if w.n:
            state = {"part": TaskContext.get().partitionId(), **_state(w.n, sums, w)}
            yield from pa.Table.from_pylist([state]).to_batches()

    def fold(states):
        sums, w = _merged(states, dims)
        return _state(w.n, sums, w)

    state = fold_states(scratch, rows.mapInArrow(stream, _STATE), fold, FAN, name)
    return _merged([state] if state else [], dims)


class Basis:
    """What whitens: exact sums, the mean, projections (columns) and the share of each component."""

    def __init__(self, n: int, sums: list[int], w: Welford, components: int):
        self.n, self.sums = n, sums
        values, vectors = eigen(w.covariance()) if n else (np.zeros(0), np.zeros((0, 0)))
        most = min(components, len(values))
        values, trace = np.maximum(values, 0.0), float(np.trace(w.covariance())) if n else 0.0
        self.real = values[:most] > ROUNDING * trace
        self.explained = [float(v / trace) if trace > 0 else 0.0 for v in values[:most]]
        self.project = np.where(self.real, vectors[:, :most] / np.sqrt(np.where(self.real, values[:most], 1.0)), 0.0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        apart = max(self.n * int(np.abs(x).max()), max(map(abs, self.sums))) if len(x) else 0
        whole = object if apart >= 1 << 62 else np.int64
        return self.n * x.astype(whole) - np.array(self.sums, whole)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x).astype(np.float64) / self.n) @ self.project

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of the squares of n * x - S, exactly."""
        d = self.deviations(x)
        if len(d) and max(abs(int(d.max())), abs(int(d.min()))) >= 1 << 28:
            d = d.astype(object)
        return [int(v) for v in (d * d).sum(1)]


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation as decimal(38, 0), whitened, explained, identity_error), `components` rows a vector."""
    spark, rows = session(table), kept(table, id_col, vector, None)
    id_type = rows.schema["id"].dataType.simpleString()
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    schema = f"id {id_type}, component int, deviation decimal(38, 0), whitened double"
    dims = common["dims"] if common else 0
    rows, scratch = rows.where(F.size("v") == dims), Scratch(spark)

    def read(batches):
        for _, x in matrices(batches, dims):
            x = x + OFFSET
            yield x, x.astype(np.float64)

    sums, w = accumulate(scratch, rows, read, dims, "state") if dims else ([], Welford(0))
    basis = Basis(w.n if dims else 0, sums, w, components)
    error, size = 0.0, len(basis.explained)
    if size:

        def again(batches):
            for x, _ in read(batches):
                z = basis.whitened(x)
                yield np.zeros(z.shape, np.int64), z

        _, z = accumulate(scratch, rows, again, size, "whitened")
        apart = np.abs(z.covariance() - np.eye(size))[np.ix_(basis.real, basis.real)]
        error = float(apart.max()) if apart.size else 0.0

    def write(batches):
        for own, x in ((i, v + OFFSET) for i, v in matrices(batches, dims)):
            at = pa.array(np.repeat(np.arange(len(x)), size))
            deviation = pa.array(basis.deviation(x), pa.decimal128(38, 0)).take(at)
            number = pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x)))
            yield pa.RecordBatch.from_arrays([own.take(at), number, deviation, pa.array(basis.whitened(x).ravel())], names=["id", "component", "deviation", "whitened"])

    out = rows.mapInArrow(write, schema) if size else spark.createDataFrame([], schema)
    share = F.element_at(F.array(*[F.lit(v) for v in basis.explained] or [F.lit(0.0)]), F.col("component"))
    return out.select(F.col("id").alias(id_col), "component", F.lit(basis.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
