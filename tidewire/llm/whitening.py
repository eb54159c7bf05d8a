"""Whitening of embeddings by incremental eigendecomposition.

A vector's entries c become whole numbers, floor(1024 c) + 100000, so counts
and sums are exact. Each task goes through its centred vectors in blocks: a
block is brought into triangular form, which has at most as many rows as
there are dimensions and the same scatter, and each of its rows z changes the
task's spectrum by one rank: Q D Q' + z z'. The new eigenvalues are the roots
of the secular equation 1 + sum(u_i^2 / (d_i - x)) = 0 with u = Q'z. Entries
of u that are nothing, and equal eigenvalues, whose entries are first rotated
into one, are deflated; the eigenvectors come from entries recomputed
so that the found roots are exact ones, which keeps them orthogonal. Spectra
of tasks are combined in groups of ``FAN`` by the same updates, in as many
rounds as there are, until one is left. A last pass over all vectors gives
the scatter within that basis, whose eigenvectors turn the basis into the
components (Rayleigh-Ritz); as the basis is a whole one, rounding of all
updates before falls out. Only tables of one row for each dimension, and
square matrices of dimensions, ever reach the driver.

Defined cases: vectors that are null, empty or hold a null or a number that
isn't finite are left out. Vectors of another length than most rows have
(the longer of two as frequent) are left out too. Rows of equal or null ids
all count and all come back. A component whose eigenvalue is nothing beside
the largest has a null in ``whitened`` (vectors all alike, or fewer of them
than dimensions) and is no part of ``identity_error``; if there is no other,
that is 0. ``explained`` is null where nothing varies. A deviation beyond a
long, and entries beyond 2**43, raise. Without vectors there are no rows.
Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, trimmed, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: The largest entry, so that whole numbers are exact.
MOST = 2.0**43
#: Rows of a block, for each dimension.
BLOCK = 64
#: Spectra that one task combines.
FAN = 8
#: An eigenvalue of less than this share of the largest is nothing.
NOTHING = 1e-13
_EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(u_i^2 / (d_i - x)) = 0 for rising, distinct ``d`` and ``u`` without zeros.

    Root i lies between d_i and d_(i+1), the last one up to d_n + |u|^2. It is
    told as the nearest pole (its number) and the distance from it, which keeps
    small distances exact: all are searched together within brackets, by steps of a fitted
    two-pole function and bisection where those fail.
    """
    n, square = len(d), u * u
    gap = np.append(np.diff(d), square.sum())
    middle = d + gap / 2
    at_middle = 1 + (square / (d - middle[:, None])).sum(axis=1)
    # Where the function is negative in the middle, the root is nearer the upper pole; the last has none.
    upper = (at_middle < 0) & (np.arange(n) < n - 1)
    pole = np.arange(n) + upper
    away = d - d[pole][:, None]
    low = np.where(upper, -gap / 2, 0.0)
    high = np.where(upper, 0.0, gap / 2)
    low[n - 1], high[n - 1] = (0.0, gap[-1] / 2) if at_middle[-1] >= 0 else (gap[-1] / 2, gap[-1])
    x = (low + high) / 2
    lower_pole, upper_pole = np.diagonal(away), np.append(np.diagonal(away, 1), np.inf)
    left = np.arange(n)[:, None] >= np.arange(n)  # poles at or below each root
    open_, last = np.arange(n), np.full(n, np.inf)
    for _ in range(200):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            at, l, h = x[open_], lower_pole[open_], upper_pole[open_]  # noqa: E741
            inverse = 1 / (away[open_] - at[:, None])
            terms = square * inverse
            below, above = (terms * left[open_]).sum(axis=1), (terms * ~left[open_]).sum(axis=1)
            f = 1 + below + above
            low[open_], high[open_] = np.where(f <= 0, at, low[open_]), np.where(f >= 0, at, high[open_])
            lo, hi = low[open_], high[open_]
            slopes = terms * inverse
            blur = 4 * n * (1 + np.abs(below) + np.abs(above)) + 2 * np.abs(at) * slopes.sum(axis=1)
            done = (np.abs(f) <= _EPS * blur) | (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if done.all():
                break
            # f(y) is taken as c + s/(l - y) + t/(h - y), with the slopes of both sides' sums.
            own = (slopes * left[open_]).sum(axis=1)
            far = np.isinf(h)
            h = np.where(far, 0.0, h)
            s = own * (l - at) ** 2
            t = np.where(far, 0.0, (slopes.sum(axis=1) - own) * (h - at) ** 2)
            c = f - s / (l - at) - np.where(far, 0.0, t / (h - at))
            # c (l - y)(h - y) + s (h - y) + t (l - y) = 0.
            b, e = -(c * (l + h) + s + t), c * l * h + s * h + t * l
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
            q = -(b + np.where(b >= 0, root, -root)) / 2
            inside = lambda y, lo=lo, hi=hi: (y > lo) & (y < hi)
            # Without an upper pole, -below is to become 1: Newton's step for its reciprocal, which is nearly straight.
            y = np.where(far, at + below * (below + 1) / own, np.where(inside(q / c), q / c, e / q))
            done |= np.abs(y - at) <= 4 * _EPS * np.abs(at)
            # A step out of the bracket, or after one that didn't bring f to a half, goes to the middle.
            good = inside(y) & (np.abs(f) <= last[open_] / 2)
            last[open_] = np.abs(f)
            x[open_] = np.where(done, at, np.where(good, y, (lo + hi) / 2))
            open_ = open_[~done]
    return pole, x


def rank_one(d: np.ndarray, q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``q diag(d) q' + z z'``, eigenvalues rising."""
    u = q.T @ z
    order = np.argsort(d, kind="stable")
    d, q, u = d[order].copy(), q[:, order].copy(), u[order].copy()
    scale = max(abs(d).max(initial=0.0), float(u @ u))
    if scale == 0:
        return d, q
    small = 8 * _EPS * scale
    # Equal eigenvalues: the entry of one is rotated into the next, which leaves nothing of it.
    last, length = -1, np.linalg.norm(u)
    for i in range(len(d)):
        if abs(u[i]) * length <= small:
            u[i] = 0
            continue
        if last >= 0 and d[i] - d[last] <= small:
            r = np.hypot(u[last], u[i])
            c, s = u[i] / r, u[last] / r
            q[:, [last, i]] = np.column_stack([c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]])
            u[last], u[i] = 0, r
        last = i
    live = np.flatnonzero(u)
    if len(live):
        e, w = d[live], u[live]
        pole, x = secular_roots(e, w)
        # (d_j - root_i), without cancellation.
        apart = (e - e[pole][:, None]) - x[:, None]
        # For each pole the product over k of (root_k - d_i) / (d_k - d_i), roots and poles paired so that factors stay near one.
        k = np.arange(len(e))
        under = np.where(k[:, None] < k, e[:, None] - e, np.append(e[1:], 0.0)[:, None] - e)
        under[-1] = 1.0
        ratio = np.abs(np.prod(-apart / under, axis=0))
        w = np.copysign(np.sqrt(ratio), w)
        vectors = w / apart
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        q[:, live] = q[:, live] @ vectors.T
        d[live] = e[pole] + x
    return d, q


class Spectrum:
    """The eigenvalues and eigenvectors of a growing scatter matrix."""

    def __init__(self, dims: int, d: np.ndarray | None = None, q: np.ndarray | None = None):
        self.d = np.zeros(dims) if d is None else d
        self.q = np.eye(dims) if q is None else q

    def add(self, z: np.ndarray) -> None:
        self.d, self.q = rank_one(self.d, self.q, z)

    def add_rows(self, rows: np.ndarray) -> None:
        """Rows by way of their triangular form, which has the same scatter."""
        for z in np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows:
            self.add(z)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.d, other.q.T, strict=True):
            if value > 0:
                self.add(np.sqrt(value) * vector)

    def row(self) -> dict:
        return {"d": self.d.tolist(), "q": self.q.ravel().tolist()}


def _lists(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``(vec_id, c)`` of the vectors that count, as doubles, and their length."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    kept = rows.where((F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    best = kept.groupBy(F.size("c").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return (kept.where(F.size("c") == best.dims), best.dims) if best else (kept, 0)


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    c = _lists(column, dims)
    if len(c) and np.abs(c).max() > MOST:
        raise ValueError(f"an entry is beyond {MOST:.0f}")
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as long integers where they hold it, and otherwise as Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(y: np.ndarray) -> list[int]:
    """The sums of squares of the rows of n x - S, exactly."""
    most = max(abs(int(y.min(initial=0))), int(y.max(initial=0)))
    if y.dtype == object or most * most * y.shape[1] >= 2**63:
        y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def column_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each dimension."""
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = whole_numbers(batch.column("c"), dims)
            for part in np.split(x, range(512, len(x), 512)):  # few enough that a sum of the largest fits
                total = [a + b for a, b in zip(total, part.sum(axis=0).tolist(), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": range(dims), "n": [n] * dims, "s": [Decimal(v) for v in total]}, schema)

    found = rows.mapInArrow(trimmed(run), "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return found[0].n, [int(r.s) for r in found]


def spectrum(rows: DataFrame, dims: int, n: int, sums: list[int]) -> Spectrum:
    """The spectrum of the scatter of all vectors: one for each task, then combined in groups."""
    spark = rows.sparkSession
    schema = "part long, d array<double>, q array<double>"

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, held, least = Spectrum(dims), [], BLOCK * dims
        for batch in batches:
            held.append(centred(whole_numbers(batch.column("c"), dims), n, sums).astype(np.float64) / n)
            if sum(map(len, held)) >= least:
                block = np.concatenate(held)
                for at in range(0, len(block) - least + 1, least):
                    own.add_rows(block[at : at + least])
                held = [block[len(block) // least * least :]]
        if held:
            own.add_rows(np.concatenate(held))
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId()} | own.row()])

    def combine(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["part"])
        of = lambda r: Spectrum(dims, np.array(r["d"]), np.array(r["q"]).reshape(dims, dims))
        own = of(found[0])
        for r in found[1:]:
            own.merge(of(r))
        return pa.Table.from_pylist([{"part": found[0]["part"] // FAN} | own.row()])

    now = written(rows.mapInArrow(trimmed(grow), schema), "spectra")
    while now.agg(F.max("part")).first()[0] > 0:
        now = written(now.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(lambda t: combine(t), schema), "spectra")
    last = now.first()
    return Spectrum(dims, np.array(last.d), np.array(last.q).reshape(dims, dims))


def scatter(rows: DataFrame, dims: int, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of y y', and of y, over all centred vectors within a basis: sums of tasks, added up by Spark."""
    k = basis.shape[1]
    at = [(i, j) for i in range(k + 1) for j in range(min(i, k - 1) + 1)]  # row k is that of the means

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = centred(whole_numbers(batch.column("c"), dims), n, sums).astype(np.float64) / n @ basis
            total += np.vstack([y.T @ y, y.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"i": [i for i, _ in at], "j": [j for _, j in at], "v": [total[p] for p in at]}, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

    out = np.zeros((k + 1, k))
    for r in rows.mapInArrow(trimmed(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v / n
        if r.i < k:
            out[r.j, r.i] = r.v / n
    return out[:k], out[k]


def components(rows: DataFrame, dims: int, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit eigenvectors as columns."""
    basis, _ = np.linalg.qr(spectrum(rows, dims, n, sums).q)
    within, _ = scatter(rows, dims, n, sums, basis)
    values, turn = np.linalg.eigh(within)
    return np.maximum(values[::-1], 0.0), (basis @ turn)[:, ::-1]


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each of the first ``k`` components (numbered
    from 1): ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    kept, dims = usable(vectors, id_col, vector_col)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    if not dims:
        return spark.createDataFrame([], f"vec_id {id_type}, {OUT}")
    k = min(k, dims)
    with scratch(spark):
        n, sums = column_sums(kept, dims)
        values, axes = components(kept, dims, n, sums)
        total = float(values.sum())
        real = int((values[:k] > NOTHING * values[0]).sum()) if total > 0 else 0
        onto = axes[:, :real] / np.sqrt(values[:real])
        error = 0.0
        if real:
            square, mean = scatter(kept, dims, n, sums, onto)
            error = float(np.abs(square - np.outer(mean, mean) - np.eye(real)).max())
    explained = [float(v / total) if total > 0 else None for v in values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            y = centred(whole_numbers(batch.column("c"), dims), n, sums)
            white = np.full((m, k), np.nan)
            white[:, :real] = y.astype(np.float64) / n @ onto
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(deviations(y), pa.int64()).take(each),
                    pa.array(white.ravel(), mask=np.tile(np.arange(k) >= real, m)),
                    pa.array(explained * m, pa.float64()),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", *(c.split()[0] for c in OUT.split(", "))],
            )

    return kept.mapInArrow(trimmed(run), f"vec_id {id_type}, {OUT}")
