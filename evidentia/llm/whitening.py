"""Whitening of vectors by pivoted Cholesky and one-sided Jacobi.

Vectors become integers, so counts, sums and deviations are exact. The scatter of the distinct
vectors, centred before they are multiplied, is added up from one matrix a task, row by row
as a stream, so no task and not the driver holds more than a square matrix of the dimension.
That matrix is factored on the driver: pivoted Cholesky gives a triangular factor, one-sided
Jacobi rotations make its columns orthogonal, their squared norms are the eigenvalues and the
columns at length one, back in the order of the dimensions, the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Fixed values of the integer form.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: The least variance of a component against the largest of a dimension; what is below is rounding.
LEAST = 1e-11
SWEEPS, ORTHOGONAL = 60, 1e-15


def pivoted_cholesky(matrix: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with matrix[order][:, order] = L @ L.T; as many columns as pivots above `least` times the first."""
    a, d = np.array(matrix, float), len(matrix)
    order, factor = np.arange(d), np.zeros((d, d))
    first = a.diagonal().max(initial=0.0)
    for k in range(d):
        rest = a.diagonal()[k:]
        p = k + int(rest.argmax())
        if not a[p, p] > least * first:
            return factor[:, :k], order
        for x in (a, factor):
            x[[k, p]] = x[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _rounds(columns: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs that share no column."""
    n = columns + columns % 2
    ring, out = np.arange(n), []
    for _ in range(n - 1):
        a, b = ring[: n // 2], ring[: n // 2 - 1 : -1]
        real = (a < columns) & (b < columns)
        out.append((a[real], b[real]))
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """factor times a rotation that makes its columns orthogonal."""
    x = np.array(factor, float)
    pairs = _rounds(x.shape[1])
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in pairs:
            a, b = x[:, i], x[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, off.max(initial=0.0))
            turn = off > ORTHOGONAL
            tau = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            t = np.where(turn, np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1.0, tau)), 0.0)
            c = 1 / np.hypot(1.0, t)
            x[:, i], x[:, j] = c * a - c * t * b, c * t * a + c * b
        if worst <= ORTHOGONAL:
            break
    return x


def eigen(matrix: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix without negative ones."""
    factor, order = pivoted_cholesky(matrix, least)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    fall = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(matrix), len(fall)))
    vectors[order] = (turned / norms)[:, fall]
    if vectors.size:  # either sign is right; the largest entry is positive, so that reruns agree
        vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return norms[fall] ** 2, vectors


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: n vectors with sums, components as columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def finite_vector(column: str) -> F.Column:
    """True for vectors with components, all of them finite; the zero vector too."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite, F.lit(False))


def integers(column: str) -> F.Column:
    return F.transform(F.col(column), lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _from_mean(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: in longs, or in Python's integers where these might not hold it."""
    s = np.array(sums, object)
    wide = n * max(1, *(int(v) for v in (x.max(initial=0), -x.min(initial=0)))) + max(map(abs, sums), default=0) >= 1 << 62
    return x.astype(object) * n - s if wide else x * np.int64(n) - s.astype(np.int64)


def _added(df: DataFrame, parts) -> dict[int, np.ndarray]:
    """The sum over all tasks of the matrices that `parts` makes of a task's batches, as a dictionary of rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = parts(_matrix(batch.column(0)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.from_numpy_dtype(total.dtype)))], ["i", "row"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            at, rows = batch.column("i")[:1], _matrix(batch.column("row"))
            total = rows.sum(0) if total is None else total + rows.sum(0)
        yield pa.RecordBatch.from_arrays([at, pa.array([total])], ["i", "row"])

    schema = f"i int, row array<{'bigint' if parts is _sums else 'double'}>"
    gather.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    rows = df.select("x").mapInArrow(local, schema).groupBy("i").applyInArrow(gather, schema)
    return {r.i: np.array(r.row) for r in rows.collect()}  # as many rows as the vectors have dimensions


def _sums(x: np.ndarray) -> np.ndarray:
    return np.vstack([np.append(x.sum(0), len(x))])


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of df; None if there is no vector.

    Vectors that are null, empty or hold null or non-finite entries take no part. Vectors of
    another length than most rows have (of equally many, the longer) take none either.
    Repeated vectors count once. Components are those with a variance above LEAST times the
    largest of a dimension: equal vectors alone have none.
    """
    rows = df.where(finite_vector(vector)).select(integers(vector).alias("x"))
    usual = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None:
        return None
    listed = staged(rows.where(F.size("x") == usual.dim).distinct(), "fit_list")
    total = _added(listed, _sums)[0]
    n, sums = int(total[-1]), tuple(int(v) for v in total[:-1])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = _from_mean(x, n, sums).astype(float) / n
        return centred.T @ centred

    parts = _added(listed, scatter)
    covariance = np.vstack([parts[i] for i in range(usual.dim)]) / n
    values, vectors = eigen((covariance + covariance.T) / 2)
    model = Whitening(n, sums, vectors[:, :components], values[:components], float(covariance.trace()))
    if not len(model.eigenvalues):
        return model

    def white_scatter(x: np.ndarray) -> np.ndarray:
        # n * x - S adds up to zero exactly, so these are centred as they come
        w = _whitened(_from_mean(x, n, sums), model)
        return w.T @ w

    parts = _added(listed, white_scatter)
    white = np.vstack([parts[i] for i in range(len(parts))]) / n
    return Whitening(n, sums, model.components, model.eigenvalues, model.trace, float(np.abs(white - np.eye(len(white))).max()))


def _whitened(z: np.ndarray, model: Whitening) -> np.ndarray:
    return (z.astype(float) / model.n) @ model.components / np.sqrt(model.eigenvalues)


def _deviations(z: np.ndarray) -> list[int]:
    most = max(int(z.max(initial=0)), -int(z.min(initial=0)))
    if most * most * z.shape[1] < 1 << 63:
        return (z * z).sum(1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in z]
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation does not fit 64 bits")
    return exact


def transform(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows of df that whitening holds for, with deviation (long) and whitened (array of double).

    Rows that `fit` leaves out are left out. Repeated rows stay repeated. Columns of these two
    names are replaced, all others kept. Without a model no row stays. A deviation above 64 bits
    is an error.
    """
    clean = df.drop("deviation", "whitened", "_white")
    schema = "struct<deviation:bigint,whitened:array<double>>"
    if model is None:
        return clean.where("false").withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")})
    dim = len(model.sums)

    def white(x: pa.Array) -> pa.Array:
        held = x.is_valid()
        z = _from_mean(_matrix(x.filter(held)).reshape(-1, dim), model.n, model.sums)
        at = iter(zip(_deviations(z), _whitened(z, model).tolist(), strict=True)) if len(z) else iter(())
        return pa.array([dict(zip(("deviation", "whitened"), next(at), strict=True)) if ok else None for ok in held.to_pylist()], pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]))

    fits = finite_vector(vector) & (F.size(vector) == dim)
    told = clean.where(fits).withColumn("_white", F.arrow_udf(white, schema)(F.when(fits, integers(vector))))
    return told.withColumns({"deviation": F.col("_white.deviation"), "whitened": F.col("_white.whitened")}).drop("_white")
