"""Whitened embeddings: principal components by spectral divide and conquer.

Tasks add up sums and centred products; only matrices as wide as a vector, whose size
does not depend on the rows, reach the driver. There the covariance is split: the polar
factor of the covariance less a shift is +1 on the subspace above the shift and -1 below
it, which gives the projector onto either; each subspace is split again until single
directions are left. Polar factors come from the QR form of the dynamically weighted
Halley iteration. The few components are then sent to all tasks.

Defined results: vectors that are null or empty, hold nulls or no finite numbers, or have
another length than most of the table's vectors (the longer of equally many) are dropped.
Repeated vectors are fitted once and returned each time. Directions without variance are
no components, so fewer than asked may come back: none at all for a single vector.
Components of equal variance are any basis of theirs, the same for all rows. A deviation
beyond 64 bits is null. Columns of the table beside id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import written

# Entries become whole multiples of one part in so many.
SCALE = 256
# Rows of a matrix that a task holds at a time.
ROWS = 8192
EPS = np.finfo(np.float64).eps


# --- the split of a symmetric matrix, on the driver: as wide as a vector ---------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH on QR."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS / 4
    one = np.eye(n)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _halves(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if the matrix is a
    multiple of the identity."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * n * EPS * np.linalg.norm(a):
        return None
    shifts = [np.median(np.diag(a)), mean]
    shifts += list(mean + spread / n * rng.uniform(-0.5, 0.5, 20))
    best = None
    for shift in shifts:
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(np.trace(projector))
        if not 0 < k < n:
            continue
        basis = rng.standard_normal((n, k))
        for _ in range(3):
            q, _ = np.linalg.qr(projector @ basis, mode="complete")
            basis = q[:, :k]
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q[:, :k], q[:, k:]
        if left <= 10 * n * EPS * np.linalg.norm(a):
            break
    return best[1:] if best else None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    rng = np.random.default_rng(13)
    found, todo = [], [np.eye(len(a))]
    while todo:
        basis = todo.pop()
        part = basis.T @ a @ basis
        halves = _halves((part + part.T) / 2, rng) if basis.shape[1] > 1 else None
        if halves is None:
            found.append(basis)
        else:
            todo += [basis @ half for half in halves]
    vectors = np.hstack(found)
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- sums over the table ----------------------------------------------------------------


def fixed_point(vector: Column) -> Column:
    """Entries as whole numbers, rounded down; null if the vector is unusable."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    off = F.exists(doubles, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(doubles, lambda c: F.floor(c * SCALE))
    return F.when(~off & (F.size(vector) > 0), x)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x) of the rows with a usable vector of the table's length."""
    fixed = vectors.select(
        F.col(f"`{id_col}`").alias("id"), fixed_point(F.col(f"`{vector}`")).alias("x")
    ).where("x is not null")
    length = fixed.groupBy(F.size("x").alias("length")).count()
    most = length.orderBy(F.desc("count"), F.desc("length")).first()
    return fixed.where(F.size("x") == (most["length"] if most else 0))


def _matrices(batches: Iterable[pa.RecordBatch], name: str = "x") -> Iterator[tuple]:
    """(batch, matrix) of at most ``ROWS`` rows each."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            column = batch.column(batch.schema.get_field_index(name))
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch, x.reshape(batch.num_rows, -1)


def _wide(x: np.ndarray, bound: float) -> np.ndarray:
    """The matrix in Python's unbounded numbers, unless 64 bits hold the bound."""
    return x if bound < 2**62 else x.astype(object)


def _most(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0
    for _, x in _matrices(batches):
        n += len(x)
        total = total + _wide(x, _most(x) * len(x)).sum(axis=0).astype(object)
    if n:
        sums = pa.array([str(s) for s in total], pa.string())
        dims = pa.array(np.arange(len(total), dtype=np.int32))
        rows = pa.array(np.full(len(total), n, np.int64))
        yield pa.RecordBatch.from_arrays([dims, rows, sums], ["dim", "n", "total"])


@dataclass(frozen=True)
class Centre:
    """Rows and exact sums of the fit list."""

    n: int
    sums: tuple[int, ...]

    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exactly."""
        bound = (_most(x) * self.n + max(abs(s) for s in self.sums)) ** 2 * len(self.sums)
        wide = _wide(x, bound)
        offs = wide * self.n - np.array(self.sums, wide.dtype)
        found = (offs * offs).sum(axis=1).tolist()
        return [d if d < 2**63 else None for d in found]


def centre(fit: DataFrame) -> Centre | None:
    sums = (
        fit.select("x")
        .mapInArrow(_sums, "dim int, n bigint, total string")
        .groupBy("dim")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .orderBy("dim")
        .collect()
    )
    return Centre(sums[0]["n"], tuple(int(r["total"]) for r in sums)) if sums else None


def _products(centred: Callable) -> Callable:
    """Sums (j = -1) and products of the columns that ``centred`` makes of a matrix."""

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = total = 0
        for _, x in _matrices(batches):
            z = centred(x)
            gram, total = gram + z.T @ z, total + z.sum(axis=0)
        if np.ndim(gram):
            i, j = np.triu_indices(len(gram))
            k = np.arange(len(gram))
            columns = [
                np.concatenate([i, k]).astype(np.int32),
                np.concatenate([j, np.full(len(k), -1)]).astype(np.int32),
                np.concatenate([gram[i, j], total]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "value"])

    return products


def _added(fit: DataFrame, centred: Callable, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and the matrix of products over the fit list."""
    parts = fit.select("x").mapInArrow(_products(centred), "i int, j int, value double")
    total, gram = np.zeros(width), np.zeros((width, width))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value")).collect():
        if j < 0:
            total[i] = value
        else:
            gram[i, j] = gram[j, i] = value
    return total, gram


@dataclass(frozen=True)
class Whitening:
    """What was fitted: the centre, components as columns over the root of their variance,
    variances, their shares, and how far whitened vectors are from unit covariance."""

    centre: Centre
    weights: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre.mean()) @ self.weights


def fit_whitening(fit: DataFrame, components: int = 4) -> Whitening | None:
    """Fitted to the rows of ``fit`` (x); None for no rows."""
    found = centre(fit)
    if found is None:
        return None
    n, mean = found.n, found.mean()
    total, gram = _added(fit, lambda x: x - mean, len(mean))
    # The mean is rounded; what it is off by goes from the products.
    covariance = gram / n - np.outer(total / n, total / n)
    values, vectors = spectrum(covariance)
    least = len(values) * EPS * max(values[0], 0.0)
    kept = int((values[:components] > least).sum())
    weights = vectors[:, :kept] / np.sqrt(values[:kept])
    off = (total / n) @ weights
    _, products = _added(fit, lambda x: (x - mean) @ weights - off, kept)
    error = float(np.abs(products / n - np.eye(kept)).max(initial=0))
    trace = float(np.trace(covariance))
    return Whitening(found, weights, values[:kept], values[:kept] / (trace or 1.0), error)


def whitened_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 4
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable
    row and component, numbered from 1 by falling variance."""
    rows = usable(vectors, id_col, vector)
    fit = written(rows.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, components)
    kind = rows.schema["id"].dataType.simpleString()
    results = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not model.weights.size:
        return rows.limit(0).selectExpr(
            f"id as `{id_col}`",
            *[f"cast(null as {t}) as {c}" for c, t in (r.split(" ") for r in results.split(", "))],
        )
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def whiten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.variances)
        for batch, x in _matrices(batches):
            m = len(x)
            ids = batch.column(batch.schema.get_field_index("id"))
            columns = [
                ids.take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.centre.n, np.int64)),
                pa.array([d for d in model.centre.deviations(x) for _ in range(k)], pa.int64()),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.explained, m)),
                pa.array(np.full(m * k, model.identity_error)),
            ]
            names = ["id", *[r.split(" ")[0] for r in results.split(", ")]]
            yield pa.RecordBatch.from_arrays(columns, names)

    found = rows.mapInArrow(whiten, f"id {kind}, {results}")
    return found.withColumnRenamed("id", id_col)
