"""Whitening of embeddings: principal components by spectral divide and conquer on the covariance.

The covariance is summed in tasks; the d x d matrix is split on the driver. For a shift s, the polar factor of V - sI, found by
dynamically weighted Halley steps (QDWH), is +1 on eigenvectors above s and -1 on those below, so (U + I) / 2 projects on the
invariant subspace above s. Bases of that subspace and of the rest make two smaller problems, down to single components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import read, settle

#: The driver and every task hold a matrix of so many rows and columns at most.
MAX_DIM = 2048
_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, non-singular matrix, by QDWH: each step maps the singular values by
    x (a + b x^2) / (1 + c x^2) with the weights that are best for the least of them, by a QR decomposition of [sqrt(c) X; I]
    where c is large and a Cholesky-like solve where it is small."""
    n = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    try:
        least = min(1.0, max(_EPS, 1 / np.linalg.norm(np.linalg.inv(x))))  # no singular value is smaller
    except np.linalg.LinAlgError:
        least = _EPS
    eye = np.eye(n)
    for _ in range(rounds):
        d = (4 * (1 - least**2) / least**4) ** (1 / 3)
        wa = math.sqrt(1 + d) + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - least**2) / (least**2 * math.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        least = min(1.0, least * (wa + wb * least**2) / (1 + wc * least**2))
        done = np.linalg.norm(new - x) <= (5 * _EPS) ** (1 / 3) * np.linalg.norm(new) and abs(1 - least) < 1e-8
        x = new
        if done:
            break
    return 1.5 * x - 0.5 * x @ (x.T @ x)  # one more Newton-Schulz step: orthogonal to rounding


def _split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, that of the larger eigenvalues first; None if all are equal to rounding."""
    n = len(v)
    middle = np.trace(v) / n
    spread = np.linalg.norm(v - middle * np.eye(n))
    if spread <= 4 * n * _EPS * np.linalg.norm(v) or not spread:
        return None
    diagonal = np.sort(np.diag(v))
    step = spread / math.sqrt(n)  # the eigenvalues' standard deviation: some lie on either side of the mean
    shifts = [np.median(diagonal), middle, *(middle + step * f for f in (0.31, -0.37, 0.07, -0.11, 0.013, -0.017, 0.61, -0.67, 0.0019, -0.0023))]
    for s in shifts:  # a shift on an eigenvalue, or outside of all, makes no projector of use
        u = polar_factor(v - s * np.eye(n))
        p = (u + np.eye(n)) / 2
        k = round(np.trace(p))
        if not 0 < k < n or np.linalg.norm(p @ p - p) > 1e-10 * n:
            continue
        # most of the subspace's dimensions are in the columns with the largest entries on the diagonal; twice for rounding
        start = np.random.default_rng(n).standard_normal((n, n))
        q = np.linalg.qr(np.hstack([p @ start[:, :k], start[:, k:] - p @ start[:, k:]]))[0]
        q = np.linalg.qr(np.hstack([p @ q[:, :k], q[:, k:] - p @ q[:, k:]]))[0]
        coupling = q[:, :k].T @ v @ q[:, k:]
        if np.linalg.norm(coupling) <= 1e-11 * np.linalg.norm(v):
            return q[:, :k], q[:, k:]
    raise ArithmeticError("no shift splits the covariance")


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; each one's largest entry is positive.
    Equal eigenvalues have any orthonormal basis of their space."""
    v = (v + v.T) / 2
    values, vectors = [], []
    todo = [np.eye(len(v))] if len(v) else []
    while todo:
        basis = todo.pop()
        inner = basis.T @ v @ basis
        inner = (inner + inner.T) / 2
        halves = _split(inner) if len(inner) > 1 else None
        if halves is None:
            values += np.diag(inner).tolist()
            vectors += list(basis.T)
        else:
            todo += [basis @ q for q in halves]
    if not vectors:
        return np.zeros(0), np.zeros((0, 0))
    order = np.argsort(-np.array(values), kind="stable")
    q = np.array(vectors).T[:, order]
    q /= np.linalg.norm(q, axis=0)
    values = np.einsum("ij,ik,kj->j", q, v, q)
    q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])
    return values, q


def _whole(column: pa.Array) -> np.ndarray:
    """Rows of a list<long> column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quantise(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Rows (key, x) with x = floor(scale * c) for each entry c as double. Rows without a vector, with an empty one or
    with a null or non-finite entry go. Entries beyond 64 bits stop at their ends."""
    slim = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("c")
            n = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = c.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN
            owner = np.repeat(np.arange(len(n)), n)
            good = (n > 0) & (np.bincount(owner, ~np.isfinite(flat), len(n)) == 0)
            x = np.clip(np.floor(flat[good[owner]] * scale), -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(n[good])])
            yield pa.RecordBatch.from_arrays([b.column("key").filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64()))], ["key", "x"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, x array<long>")


@dataclass
class Centre:
    """n rows with exact sums per dimension. Rows are centred as whole numbers first: x less the rounded mean, less the
    rest of at most a half, so nothing is lost where the mean is large."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.middle = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        self.rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.middle)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        near = x - self.middle
        wraps = (x >= 0) & (self.middle < 0) & (near < 0) | (x < 0) & (self.middle >= 0) & (near > 0)  # beyond 64 bits
        return np.where(wraps, x.astype(float) - self.middle.astype(float), near.astype(float)) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)^2, exactly; None beyond 64 bits."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums))
        if most * most * x.shape[1] < 1 << 63:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        wide = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in wide]


def fit_centre(fit: DataFrame) -> Centre | None:
    """Count and exact sums of the rows x. Each task sends one row per dimension; halves of 32 bits can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for b in batches:
            if len(b):
                x = _whole(b.column("x"))
                n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(np.full(len(high), n), pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["i", "n", "high", "low"])

    parts = fit.mapInArrow(run, "i int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect())
    return Centre(rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]) if rows else None


def _products(rows: DataFrame, column: str, vectors) -> np.ndarray:
    """Sum over rows of the outer products of vectors(matrix), summed within tasks before the upper triangles are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                w = vectors(_whole(b.column(column)))
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "p"])

    cells = rows.select(column).mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toArrow()
    i, j, p = (cells.column(c).to_numpy() for c in ("i", "j", "p"))
    out = np.zeros((i.max(initial=-1) + 1, j.max(initial=-1) + 1))
    out[i, j] = out[j, i] = p
    return out


@dataclass
class Whitening:
    """Fitted components: x is centred, projected on a column of `vectors` and divided by the root of its eigenvalue."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components above rounding; the others have no variance to bring to one."""
        return int((self.values > len(self.values) * _EPS * self.values.max(initial=0)).sum())

    def apply(self, x: np.ndarray, k: int) -> np.ndarray:
        k = min(k, self.rank)
        return self.centre.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def fit_whitening(fit: DataFrame) -> Whitening | None:
    """Components of the distinct rows x; None if there are none. All vectors must have the same length, MAX_DIM at most."""
    lengths = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] is None:
        return None
    if lengths[0] != lengths[1] or lengths[1] > MAX_DIM:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} entries; all must have as many, {MAX_DIM} at most")
    centre = fit_centre(fit)
    v = _products(fit, "x", centre.centred) / centre.n
    values, vectors = spectral_components(v)
    return Whitening(centre, values, vectors, float(np.trace(v)))


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) for each usable row of vectors and each of
    the first components.

    Components are fitted on the distinct quantised vectors, each once however often it is repeated, and apply to all
    rows; repeated rows and ids keep a row each, null ids too. If there is no usable row the result is empty.
    Components without variance (fewer distinct vectors than dimensions, say) have a null `whitened`; identity_error is over
    the others and null without any. A deviation beyond 64 bits is null. Other columns are not read.

    The distinct vectors are written to the shared folder and read in three passes, each of which sends a triangle of sums per
    task; repeated vectors are combined before they are shuffled.
    """
    rows = quantise(vectors, key, column, scale)
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    fit = settle(rows.select("x").distinct())
    found = fit_whitening(fit)
    if found is None:
        return spark.createDataFrame([], out).withColumnRenamed("key", key)
    k = min(components, len(found.values))
    error = None
    if found.rank:
        seen = _products(fit, "x", lambda x: found.apply(x, k)) / found.centre.n
        error = float(np.abs(seen - np.eye(len(seen))).max())
    explained = (found.values[:k] / found.trace).tolist() if found.trace > 0 else [None] * k
    sent = spark.sparkContext.broadcast(Whitening(found.centre, found.values, found.vectors[:, :k], found.trace))  # MAX_DIM rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            m = len(b)
            if not m:
                continue
            x = _whole(b.column("x"))
            y = np.full((m, k), np.nan)
            got = w.apply(x, k)
            y[:, : got.shape[1]] = got
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, w.centre.n), pa.int64()),
                    pa.array(w.centre.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(y.ravel(), pa.float64(), mask=np.isnan(y.ravel())),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
