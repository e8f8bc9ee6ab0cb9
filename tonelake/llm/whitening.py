"""Whitening of embeddings: Welford's rank-one updates in each partition, merged by the parallel formula, symmetric QR.

A row whose vector is null, or holds a null, a NaN or an infinity, is dropped. An entry c becomes the whole number
floor(SCALE * c), so that equal vectors are equal exactly and sums have no order. The fit list holds each distinct vector once:
copies are folded before they are shuffled, so that a vector of a third of all rows is one row of each map task.

Each partition of the fit list streams through Welford's update: the mean moves by the new difference over the count,
and the scatter gains the outer product of the differences before and after. treeReduce merges the partitions' moments on
executors (n, means, scatters; exact sums beside them) and the driver gets one: d x d numbers, whatever the rows.
The covariance is reduced to tridiagonal form by Householder reflections and diagonalised by implicit QR steps
with Wilkinson's shift. A second pass over the fit list measures the covariance of what comes out, by the same moments.

Equal eigenvalues leave their components free to rotate; all rows get the same ones. Directions without variance
(eigenvalue below 1e-12 of the largest) give no component, so a single distinct vector gives no rows. Vectors of other
lengths than most of the fit list have (ties: the longer) are of another space and dropped. Sums and deviations are exact
for entries below 2**53; a deviation beyond 64 bits is null. Rows that repeat, and null ids, come out as often as they went in. Columns
besides the id and the vector are kept by ``whitened`` and don't matter to ``fit``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.llm.common import counted, in_arrow, remove, table, unused

SCALE, COMPONENTS, FLAT = 256, 4, 1e-12
_MOMENTS = "n long, mean binary, scatter binary, sums array<decimal(38,0)>"


class Moments(NamedTuple):
    """Count, mean, scatter (sum of outer products of centred vectors) and exact sums of vectors."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray

    @staticmethod
    def none(d: int) -> "Moments":
        return Moments(0, np.zeros(d), np.zeros((d, d)), np.zeros(d, object))

    def merged(self, other: "Moments") -> "Moments":
        """The parallel formula: both scatters and the outer product of the means' difference."""
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, self.sums + other.sums)


class Model(NamedTuple):
    """What whitens: rows of ``components`` are unit eigenvectors, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.components.T / np.sqrt(self.eigenvalues)


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are numbers; never null."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def scaled(df: DataFrame, vector: str = "embedding", out: str = "x", scale: int = SCALE) -> DataFrame:
    """Rows with a usable vector, with its entries as whole numbers in ``out``."""
    return df.where(usable(vector)).withColumn(out, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def welford(of: Moments, rows: np.ndarray) -> Moments:
    """``of`` after one more update by each row."""
    n, mean, scatter = of.n, of.mean.copy(), of.scatter.copy()
    for x in rows.astype(np.float64):
        n += 1
        before = x - mean
        mean += before / n
        scatter += np.multiply.outer(before, x - mean)
    whole = rows.dtype == np.int64
    near = whole and len(rows) and float(np.abs(rows.astype(np.float64)).max()) * len(rows) < 2.0**62
    sums = rows.sum(axis=0).astype(object) if near else rows.astype(object).sum(axis=0) if whole else np.zeros(rows.shape[1], object)
    return Moments(n, mean, scatter, of.sums + sums)


def moments(fit_list: DataFrame, d: int, model: Model | None = None) -> Moments:
    """Moments of all vectors of ``x``, or of what ``model`` makes of them."""
    size = d if model is None else len(model.eigenvalues)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Moments.none(size)
        for batch in batches:
            rows = _matrix(batch.column(0))
            of = welford(of, rows if model is None else model.apply(rows))
        sums = pa.array([[Decimal(int(s)) for s in of.sums]], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([of.n]), pa.array([of.mean.tobytes()]), pa.array([of.scatter.tobytes()]), sums], ["n", "mean", "scatter", "sums"])

    def read(r) -> Moments:
        return Moments(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(size, size), np.array([int(s) for s in r["sums"]], object))

    parts = in_arrow(fit_list.where(F.size("x") == d).select("x"), update, _MOMENTS).rdd.map(read)
    return parts.treeReduce(Moments.merged) if parts.getNumPartitions() else Moments.none(size)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q of a symmetric matrix: q.T @ a @ q is tridiagonal."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        long = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= long
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = long
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, by implicit QR steps on the tridiagonal form."""
    d, e, q = tridiagonal(a)
    eps, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        e[np.abs(e) <= eps * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, o, n = d[k], e[k], d[k + 1]
            d[k], d[k + 1], e[k] = c * c * p - 2 * c * s * o + s * s * n, s * s * p + 2 * c * s * o + c * c * n, c * s * (p - n) + (c * c - s * s) * o
            if k < hi - 1:
                x, z = e[k], -s * e[k + 1]
                e[k + 1] *= c
            q[:, k : k + 2] = q[:, k : k + 2] @ np.array([[c, s], [-s, c]])
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Model | None:
    """The model of a table's distinct vectors; none where no direction has variance."""
    spark = df.sparkSession
    distinct = scaled(df, vector, "x", scale).select("x").distinct()
    fit_list, path, seen = counted(distinct, "vectors", least=F.min(F.size("x")), most=F.max(F.size("x")))
    d = seen["most"] or 0
    if seen["least"] != seen["most"]:
        d = fit_list.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()["d"]
    if not d:
        return None
    of = moments(fit_list, d)
    v = (of.scatter + of.scatter.T) / (2 * of.n)
    e, q = symmetric_qr(v)
    k = min(components, int((e > max(FLAT * e[0], 0.0)).sum()))
    if not k:
        return None
    model = Model(of.n, [int(s) for s in of.sums], q[:, :k].T.copy(), e[:k].copy(), float(np.trace(v)), 0.0)
    out = moments(fit_list, d, model)
    remove(spark, path)
    return model._replace(identity_error=float(np.abs(out.scatter / out.n - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - S)**2, exact; null beyond 64 bits."""
    about = (x.astype(np.float64) * n - np.array(sums, np.float64)) ** 2
    if not len(x) or (about.sum(axis=1).max() < 2.0**61 and float(np.abs(x.astype(np.float64)).max()) * n < 2.0**61):
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist() if len(x) else []
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whitened(df: DataFrame, model: Model, vector: str = "embedding", out: str = "whitened", deviation: str = "deviation", scale: int = SCALE) -> DataFrame:
    """Rows with a usable vector of the model's length, with their whitened vector (array of doubles) and deviation."""
    keep = df.columns
    x_ = unused([*keep, out, deviation], "_x")[0]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            x = _matrix(batch.column(x_)) if len(batch) else np.zeros((0, len(of.sums)), np.int64)
            w = pa.array(list(of.apply(x)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), w, pa.array(deviations(x, of.n, of.sums), pa.int64())], [*keep, out, deviation])

    rows = scaled(df, vector, x_, scale).where(F.size(x_) == len(model.sums))
    return in_arrow(rows, apply, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.LongType())]))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    if model is None:
        return rows.limit(0).selectExpr("vec_id", "1 AS component", "1L AS n", "1L AS deviation", "1D AS whitened", "1D AS explained", "1D AS identity_error")
    out = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.get(F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]), F.col("i"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
