"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are orthogonalised by passes over the data: each pass sums the Gram matrix of
Q = A R1^-1 R2^-1 ... in every task, its Cholesky factor is the next R, and rows go through one more triangular
solve in the pass after it. The first factor is taken with a shift, which keeps it positive definite
whatever the condition of A. The product R of the factors holds all of A but its rotation, so the singular
values and right vectors of R are those of A, without squaring the condition as the covariance would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.session import settle

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Beyond this an entry has no long x; such rows are dropped like those with infinite entries.
LARGEST = 2.0**56
MOST_PASSES = 8
#: Singular values below this share of the largest are rounding, not variance.
RANK = 1e-12
_ROWS_AT_ONCE = 4096


def usable(vector: Column) -> Column:
    """Not null, and all entries finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST)), F.lit(False))


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 c) of each row's entries; a shorter vector goes on with zeros."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _distinct(width: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _integers(batch.column(0), width).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["x"])

    return run


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64).reshape(-1, width)


def _sums(width: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            rows = _matrix(batch.column(0), width, kind)
            n += len(rows)
            # Halves of the numbers cannot overflow in a batch; the sums are whole numbers of any size.
            high, low = (rows >> 32).sum(0).tolist(), (rows & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + lo for t, h, lo in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(t) for t in total], pa.string()), pa.array([n] * width, pa.int64())],
                                         names=["dim", "total", "n"])

    return run


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S as whole numbers, in 64 bits where they fit; S of floor(64 c), as the offset falls out."""
    largest = max(int(np.abs(rows).max(initial=0)), 1)
    if n * largest + max(map(abs, sums), default=0) < 1 << 62:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def _squares(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where one is no 64-bit number."""
    largest = int(np.abs(deviations).max(initial=0)) if deviations.size else 0
    if largest * largest * max(deviations.shape[1], 1) < 1 << 63:
        return (deviations.astype(np.int64) ** 2).sum(1).tolist()
    totals = (deviations.astype(object) ** 2).sum(1).tolist()
    return [int(t) if t < 1 << 63 else None for t in totals]


def solve_triangular(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, column after column."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _orthogonal(deviations: np.ndarray, n: int, factors: list[np.ndarray]) -> np.ndarray:
    rows = deviations.astype(np.float64) / n
    for r in factors:
        rows = solve_triangular(rows, r)
    return rows


def _products(transform, width: int, kind: str, size: int):
    """Each task's sums of products of all pairs of columns, and of the columns (row ``size``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            for at in range(0, len(batch), _ROWS_AT_ONCE):
                rows = transform(_matrix(batch.column(0).slice(at, _ROWS_AT_ONCE), width, kind))
                total[:size] += rows.T @ rows
                total[size] += rows.sum(0)
        for i in range(size + 1):
            yield pa.RecordBatch.from_arrays([pa.array([i] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(total[i])], names=["i", "j", "value"])

    return run


def _gram(fit: DataFrame, transform, width: int, kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(Gram matrix, column sums) of the transformed rows. Tasks' sums are added by cell, not on the driver,
    which receives one number per cell whatever the number of rows or tasks."""
    cells = fit.mapInArrow(_products(transform, width, kind, size), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    whole = np.zeros((size + 1, size))
    for r in cells.collect():
        whole[r.i, r.j] = r.value
    return (whole[:size] + whole[:size].T) / 2, whole[size]


def cholesky(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram; with the shift that rounding in the Gram sums calls for, where asked or needed."""
    size = len(gram)
    shift = 11 * (n * size + size * (size + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift *= 10


@dataclass
class Whitening:
    """What ``fit`` found; ``components`` has one column per component, largest variance first."""

    width: int
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total_variance: float
    identity_error: float
    passes: int

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ self.components / np.sqrt(self.variances)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct integer vectors floor(64 c), None where no vector has an entry.

    Vectors that are null or hold null, non-finite or (beyond 2^56) unbounded entries take no part. A vector
    shorter than the longest goes on with zeros. Copies count once. Directions without variance give no component.
    """
    rows = vectors.select(F.col(vector).alias("v")).where(usable(F.col("v")))
    size = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))), F.lit(0.0))).alias("largest")).first()
    if not size.width:
        return None
    width, kind = size.width, "<i4" if size.largest < 2.0**24 else "<i8"
    # Equal vectors meet in each task before they are shuffled, so copies cost one row a task.
    distinct = settle(rows.mapInArrow(_distinct(width, kind), "x binary").distinct(), "distinct")
    summed = distinct.mapInArrow(_sums(width, kind), "dim int, total string, n long").groupBy("dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    n, sums = summed[0].n, [int(r.total) for r in summed]
    factors: list[np.ndarray] = []
    while True:
        used = list(factors)
        gram, _ = _gram(distinct, lambda x: _orthogonal(_deviations(x, n, sums), n, used), width, kind, width)
        if not factors:
            variance = float(np.trace(gram)) / n
        # Done when Q is orthonormal but for directions that A does not have.
        if variance == 0 or len(factors) == MOST_PASSES or (factors and np.abs(gram @ gram - gram).max() < 1e-8):
            break
        factors.append(cholesky(gram, n, shifted=not factors))
    if variance == 0:
        return Whitening(width, n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    whole = np.eye(width)
    for r in factors:
        whole = r @ whole
    # What the last Gram differs from the identity by belongs to R too.
    values, axes = np.linalg.eigh(gram)
    whole = (axes * np.sqrt(np.maximum(values, 0))) @ axes.T @ whole
    _, singular, right = np.linalg.svd(whole)
    kept = min(components, int((singular > RANK * singular[0]).sum()))
    model = Whitening(width, n, sums, right[:kept].T.copy(), singular[:kept] ** 2 / n, float((singular**2).sum()) / n, 0.0, len(factors))
    second, first = _gram(distinct, lambda x: model.whitened(_deviations(x, n, sums)), width, kind, kept)
    model.identity_error = float(np.abs(second / n - np.outer(first, first) / n**2 - np.eye(kept)).max())
    return model


def apply(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: vec_id, deviation, whitened (array). A scan; the model is width x components numbers."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v")).where(usable(F.col("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), _ROWS_AT_ONCE):
                batch = whole.slice(at, _ROWS_AT_ONCE)
                deviations = _deviations(_integers(batch.column(1), model.width), model.n, model.sums)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_squares(deviations), pa.int64()), pa.array(list(model.whitened(deviations)), pa.list_(pa.float64()))],
                                                 names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact squared distance, n times scaled, from the mean, null beyond 64 bits. Null ids and repeated rows stay. No
    usable vector, or none that differs from the others, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    model = fit(vectors, vector, components)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return spark.createDataFrame([], out)
    found = apply(vectors, model, vec_id, vector).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(float(v / model.total_variance)) for v in model.variances])
    return found.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                        F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
