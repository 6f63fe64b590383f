"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers, so sums and products are exact in any order: every task adds up the products of its rows and hands on
the limbs of the totals, which Spark sums by dimension pair. The centred scatter n * sum(x x') - S S' is then exact, too. It has the
size of a vector squared, whatever the number of rows, and is factored on the driver: pivoted Cholesky gives V = L L', and
rotations from the right make L's columns orthogonal. Their squared norms are the eigenvalues, the columns at length 1 the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Products of numbers below 2**20 in blocks of 2**12 rows are exact in doubles.
_SMALL, _BLOCK, _LIMB = 1 << 20, 1 << 12, 48
_SWEEPS = 60


@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]  # of x without SHIFT
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # components as columns
    trace: float

    def centred(self, y: np.ndarray) -> np.ndarray:
        return y - np.array([s / self.n for s in self.sums])

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ self.vectors / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2; null where one is beyond 64 bits."""
        near = ((self.n * self.centred(y)) ** 2).sum(1)
        # Arithmetic modulo 2**64 is exact wherever the result itself fits.
        wrap = np.array([s % (1 << 64) for s in self.sums], np.uint64)
        whole = np.clip(y, -2.0**62, 2.0**62).astype(np.int64).view(np.uint64)
        apart = whole * np.uint64(self.n) - wrap
        out = (apart * apart).sum(1, dtype=np.uint64).view(np.int64).tolist()
        for i in np.flatnonzero(~(near < 2.0**62)):
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(y[i], self.sums)) if near[i] < 2.0**64 else 1 << 63
            out[i] = exact if exact < 1 << 63 else None
        return out


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def whole_numbers(column: pa.ListArray, width: int) -> np.ndarray:
    """floor(SCALE * c) of each entry, as doubles that hold whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(-1, width) * SCALE)


def fit(vectors: DataFrame, width: int) -> Model | None:
    """The model over all rows of the one column of ``vectors``; None for no rows or no spread."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                y = whole_numbers(batch.column(0).slice(at, _BLOCK), width)
                # A column of ones beside the numbers: sums and the row count come out of the same product.
                z = np.hstack([np.ones((len(y), 1)), y])
                small = (np.abs(y) < _SMALL).all(1)
                total += (z[small].T @ z[small]).astype(np.int64)
                for row in z[~small]:
                    exact = np.array([int(v) for v in row], object)
                    total += np.outer(exact, exact)
        rows = [(i, j, k, part) for i in range(width + 1) for j in range(i + 1) for k, part in _limbs(int(total[i, j]))]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                              names=["i", "j", "k", "part"])

    summed = vectors.mapInArrow(moments, "i int, j int, k int, part long").groupBy("i", "j", "k").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    whole = [[0] * (width + 1) for _ in range(width + 1)]
    for r in summed.collect():  # pairs of dimensions by limb: bounded by the width
        whole[r.i][r.j] += int(r.part) << _LIMB * r.k
        whole[r.j][r.i] = whole[r.i][r.j]
    n, sums = whole[0][0], whole[0][1:]
    if n == 0:
        return None
    scatter = [[n * whole[i + 1][j + 1] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    # Quotients of whole numbers are rounded once.
    covariance = np.array([[v / (n * n) for v in row] for row in scatter])
    values, vectors_ = eigen(covariance)
    return Model(n, sums, values, vectors_, sum(scatter[i][i] for i in range(width)) / (n * n)) if len(values) else None


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = -1 if value < 0 else 1, abs(value), 0
    while value:
        yield k, sign * (value & (1 << _LIMB) - 1)
        value, k = value >> _LIMB, k + 1


def cholesky(matrix: np.ndarray) -> np.ndarray:
    """L with L L' = ``matrix``, largest remaining diagonal first: triangular up to the order of its rows; as many columns as the rank."""
    left = matrix.diagonal().copy()
    columns: list[np.ndarray] = []
    for _ in range(len(matrix)):
        p = int(np.argmax(left))
        if left[p] <= len(matrix) * np.finfo(float).eps * matrix.diagonal().max():
            break
        done = np.array(columns).reshape(len(columns), len(matrix))
        column = (matrix[p] - done[:, p] @ done) / np.sqrt(left[p])
        column[left == -np.inf] = 0
        left = np.where(left == -np.inf, left, left - column * column)
        left[p] = -np.inf
        columns.append(column)
    return np.array(columns).reshape(len(columns), len(matrix)).T


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and unit eigenvectors as columns, of a positive semidefinite matrix."""
    scale = matrix.diagonal().max(initial=0)
    if scale <= 0:
        return np.empty(0), np.empty((len(matrix), 0))
    a = cholesky(matrix / scale)
    rank = a.shape[1]
    # Round robin: every round rotates pairs without a common column, all at once.
    ring = list(range(rank + rank % 2))
    for _ in range(_SWEEPS):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = (np.array(x, int) for x in (ring[:len(ring) // 2], ring[:len(ring) // 2 - 1:-1]))
            real = (p < rank) & (q < rank)
            p, q = p[real], q[real]
            ap, aq = a[:, p], a[:, q]
            pp, qq, pq = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            size = np.sqrt(pp * qq)
            turn = np.abs(pq) > 1e-16 * size
            worst = max(worst, float((np.abs(pq) / np.where(size > 0, size, 1)).max(initial=0)))
            zeta = (qq - pp) / np.where(turn, 2 * pq, 1)
            t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            a[:, p], a[:, q] = c * ap - c * t * aq, c * t * ap + c * aq
            ring.insert(1, ring.pop())
        if worst <= 4e-15:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    # What is left of linearly dependent columns is rounding.
    order = order[norms[order] ** 2 > 8 * len(matrix) * np.finfo(float).eps * norms.max() ** 2]
    return norms[order] ** 2 * scale, a[:, order] / norms[order]


def whiten(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, component, n, deviation, whitened, explained and identity_error: a row for each usable vector and component.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another length than the commonest
    (of equally common ones the longest). Repeated rows, null ids and ties count as they are. Only as many components come out as the covariance
    has eigenvalues above rounding: none for an empty table, one vector, or equal ones. Equal eigenvalues have one orthonormal choice of
    components, the same for all rows. deviation is null where it passes 64 bits. Other columns are left out.
    """
    id_type = table.schema[vec_id].dataType.simpleString()
    rows = table.select(table[vec_id].alias("_id"), table[vector].cast("array<double>").alias("_v")).filter(_usable(F.col("_v")))
    schema = f"_id {id_type}, component int, n long, deviation long, whitened double, explained double"
    common = rows.groupBy(F.size("_v").alias("width")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("width")).first()
    rows = rows.filter(F.size("_v") == (common.width if common else 0))
    model = fit(rows.select("_v"), common.width) if common else None
    if model is None:
        out, error = rows.sparkSession.createDataFrame([], schema), 0.0
    else:
        model = Model(model.n, model.sums, model.values[:components], model.vectors[:, :components], model.trace)
        out, error = rows.mapInArrow(_rows(model), schema), identity_error(rows.select("_v"), model)
    return out.select(F.col("_id").alias(vec_id), *(F.col(c) for c in ("component", "n", "deviation", "whitened", "explained")), F.lit(error).alias("identity_error"))


def _rows(model: Model):
    kept = len(model.values)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole_numbers(batch.column(1), len(model.sums))
            count = len(y)
            yield pa.record_batch([
                batch.column(0).take(pa.array(np.repeat(np.arange(count), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                pa.array(np.full(count * kept, model.n, np.int64)), pa.array(model.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(count), kept))),
                pa.array(model.whitened(y).ravel()), pa.array(np.tile(model.values / model.trace, count)),
            ], names=["_id", "component", "n", "deviation", "whitened", "explained"])

    return write


def identity_error(vectors: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    kept = len(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept, kept))
        for batch in batches:
            w = model.whitened(whole_numbers(batch.column(0), len(model.sums)))
            total += w.T @ w / model.n
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(x.ravel()) for x in (i, j, total)], names=["i", "j", "v"])

    sums = vectors.mapInArrow(products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max(abs(r.v - (r.i == r.j)) for r in sums)
