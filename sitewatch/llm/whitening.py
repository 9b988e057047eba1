"""Embedding whitening with eigenpairs found by contour integration (operator 12).

Two passes add up, in whole numbers, what the covariance needs: the sums of all
components, then the products of components centred at the whole number nearest their
mean.  The part of the mean below one is taken off exactly, so the covariance is the
exact one, rounded once for each entry.

The eigenpairs come from FEAST on the covariance V:

* V is brought to a tridiagonal T of the same inertia.  The signs of the pivots of
  T - sI count the eigenvalues below s; bisection with these counts places intervals
  around at most ``MOST_INTERVAL`` of the wanted eigenvalues, their ends in the widest
  gaps near;
* for each interval, a task integrates the resolvent applied to a block of vectors over
  a half circle (Gauss-Legendre quadrature of complex shifted solves), which projects
  them onto the interval's eigenspace; Rayleigh-Ritz in it gives eigenpairs, and this
  repeats until their residuals stop falling;
* the number found in an interval must be the difference of the inertia counts at its
  ends.  Where it is not, the block is made larger, at last as large as V;
* one Rayleigh-Ritz step over all found vectors makes them orthogonal across intervals.

Another pass checks the covariance of the whitened vectors; the last one writes them.
The driver holds matrices of a vector's length squared, whatever the number of rows.

Defined cases: see ``wholes`` for the rows that take part; each length of vectors has a
fit of its own, and a vector without entries no component.  Components are those of
eigenvalues above rounding (length x 2^-50 of the largest), so that a table of few or
equal rows may have fewer, and one of one row none.  Equal eigenvalues have any
orthonormal vectors of their space, the same for all rows.  The sign of a component
makes its largest entry positive.  A deviation beyond a long is null.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table
from .wholes import as_longs, exact, lengths, matrix, size, sums_of, whole_vectors

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
NODES = 16                  # of the quadrature on a half circle
MOST_INTERVAL = 8           # eigenvalues in an interval, but for clusters
ROUNDING = 2.0 ** -50
SWEEPS = 12                 # projections of a block at most
STEP = 1 << 14              # rows multiplied together


# --- eigenpairs -------------------------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix similar to the symmetric ``a`` (Householder)."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0.0:
            continue
        end = -norm if v[0] > 0 else norm
        v[0] -= end
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        q = 2.0 * (rest @ v)
        w = q - (v @ q) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = end
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def count_above(tri: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """By inertia: the number of eigenvalues above each shift."""
    diagonal, off = tri
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot = np.ones_like(shifts)
    above = np.zeros(len(shifts), dtype=np.int64)
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (off[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0
    return above


def largest(tri: tuple[np.ndarray, np.ndarray], n: int, low: float, high: float) -> np.ndarray:
    """About the n largest eigenvalues, falling, by bisection with inertia counts."""
    lo, hi = np.full(n, low), np.full(n, high)
    rank = np.arange(1, n + 1)
    for _ in range(48):
        mid = (lo + hi) / 2
        up = count_above(tri, mid) >= rank
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


@dataclass(frozen=True)
class Interval:
    low: float
    high: float
    count: int              # eigenvalues in it, by inertia


def intervals(tri: tuple[np.ndarray, np.ndarray], wanted: int) -> list[Interval]:
    """Intervals that hold the ``wanted`` largest eigenvalues above rounding, from the top."""
    diagonal, off = tri
    reach = np.sqrt(np.concatenate([[0.0], off])) + np.sqrt(np.concatenate([off, [0.0]]))
    top = float((np.abs(diagonal) + reach).max())
    floor = ROUNDING * len(diagonal) * top
    n = min(wanted, int(count_above(tri, np.array([floor]))[0]))
    if n <= 0 or top == 0.0:
        return []
    least = floor / 2
    values = largest(tri, min(n + MOST_INTERVAL, len(diagonal)), -top, top * 1.001)
    values = values[: max(n, int((values > floor).sum()))]
    below = np.append(values[1:], least)
    gaps = values - below
    out: list[Interval] = []
    high, at = values[0] + max(gaps.max(), top * 1e-3), 0
    while at < n:
        last = min(at + MOST_INTERVAL, n)           # the interval's eigenvalues are at .. stop - 1
        open_ = np.arange(at + 1 if last < n else last, last + 1)
        stop = int(open_[np.argmax(gaps[open_ - 1])])
        while gaps[stop - 1] < 1e-9 * top and stop < len(values):       # no end inside a cluster
            stop += 1
        low = float(values[stop - 1] - gaps[stop - 1] / 2)
        a, b = count_above(tri, np.array([low, high])).tolist()
        out.append(Interval(low, float(high), int(a - b)))
        high, at = low, stop
    return out


def project(v: np.ndarray, part: Interval, block: np.ndarray) -> np.ndarray:
    """The block's part in the interval's eigenspace, by quadrature of (zI - V)^-1 over a circle around it."""
    centre, radius = (part.low + part.high) / 2, (part.high - part.low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(block)
    for x, w in zip(points, weights):
        turn = radius * np.exp(1j * np.pi / 2 * (1 - x))        # the lower half is its conjugate
        z = centre + turn
        out += (w / 2) * np.real(turn * np.linalg.solve(z * np.eye(len(v)) - v, block.astype(complex)))
    return out


def ritz(v: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues, rising, and vectors of V in the space of the basis."""
    q, _ = np.linalg.qr(basis)
    h = q.T @ (v @ q)
    values, u = np.linalg.eigh((h + h.T) / 2)
    return values, q @ u


def solve_interval(v: np.ndarray, part: Interval) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs in an interval, as many as inertia counts there."""
    n, scale = len(v), float(np.linalg.norm(v))
    width = min(n, max(part.count + 4, part.count * 3 // 2))
    while True:
        block = np.random.default_rng(part.count).standard_normal((n, width))
        least, best = np.inf, None
        for _ in range(SWEEPS if width < n else 1):
            values, vectors = ritz(v, project(v, part, block) if width < n else block)
            inside = (values > part.low) & (values <= part.high)
            if inside.sum() == part.count:
                x = vectors[:, inside]
                residual = float(np.linalg.norm(v @ x - x * values[inside], axis=0).max(initial=0.0))
                if residual >= least / 2:
                    break           # nothing more to gain
                least, best = residual, (values[inside], x)
            block = vectors
        if best is not None and (least <= 1e-13 * scale or width == n):
            return best
        if width == n:
            raise ArithmeticError(f"inertia counts {part.count} eigenvalues in {part}, not as many were found")
        width = min(n, 2 * width)


def eigenpairs(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding, falling, and their vectors as rows; a task an interval."""
    parts = intervals(tridiagonal(v), wanted) if len(v) else []
    if not parts:
        return np.zeros(0), np.zeros((0, len(v)))
    shared = spark.sparkContext.broadcast(v)        # length x length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns)):
                values, vectors = solve_interval(shared.value, Interval(low, high, count))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["value", "vector"])

    given = spark.createDataFrame([(p.low, p.high, p.count) for p in parts], "low double, high double, count int").repartition(len(parts))
    found = in_arrow(given, run, "value double, vector array<double>").collect()       # wanted x length numbers
    if len(found) != sum(p.count for p in parts):
        raise ArithmeticError("the intervals' eigenvalues are not as many as inertia counts")
    values, vectors = ritz(v, np.array([r["vector"] for r in sorted(found, key=lambda r: -r["value"])]).T)
    order = np.argsort(-values, kind="stable")[:wanted]
    rows = vectors.T[order]
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return values[order], rows * signs[:, None]


# --- passes over the rows ------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """A fit: whole vectors z of one length become (z - mean) . components / sqrt(values)."""
    n: int
    total: np.ndarray       # sums of z by entry, Python integers
    values: np.ndarray
    components: np.ndarray  # a row each
    trace: float


def _totals(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(dim, dtype=object), 0
    for batch in batches:
        if batch.num_rows:
            z = matrix(batch.column(0), dim)
            total += exact(z, size(z) * len(z)).sum(axis=0).astype(object)
            n += len(z)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([Decimal(int(x)) for x in total], pa.decimal128(38)),
                                      pa.array(np.full(dim, n, dtype=np.int64))], names=["i", "total", "n"])


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums of products of centred entries, for each pair of entries once."""
    dim = len(centre)
    total = np.zeros((dim, dim), dtype=object)
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            z = matrix(batch.column(0).slice(i, STEP), dim) - centre
            bound = size(z) ** 2 * len(z)
            if bound < 1 << 53:         # exact in doubles
                y = z.astype(np.float64)
                total += (y.T @ y).astype(np.int64).astype(object)
            else:
                y = z.astype(object)
                total += y.T @ y
    i, j = np.triu_indices(dim)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                      pa.array([Decimal(int(x)) for x in total[i, j]], pa.decimal128(38))], names=["i", "j", "total"])


def covariance(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums of entries, covariance with divisor n) of the column v of one length."""
    total, n = np.zeros(dim, dtype=object), 0
    for r in sums_of(in_arrow(rows.select("v"), lambda it: _totals(it, dim), "i int, total decimal(38,0), n long"), ["i"], ["total", "n"]):
        total[r["i"]], n = int(r["total"]), r["n"]
    centre = np.array([(2 * t + n) // (2 * n) for t in total], dtype=np.int64) if n else np.zeros(dim, dtype=np.int64)
    rest = [int(t) - n * int(c) for t, c in zip(total, centre)]
    v = np.zeros((dim, dim))
    products = in_arrow(rows.select("v"), lambda it: _products(it, centre), "i int, j int, total decimal(38,0)")
    for r in sums_of(products, ["i", "j"], ["total"]):
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / (n * n)      # Python divides whole numbers with one rounding
    return n, total, v


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    n, total, v = covariance(rows, dim)
    values, vectors = eigenpairs(rows.sparkSession, v, components)
    return Whitening(n, total, values, vectors, float(np.trace(v)))


def _apply(z: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(n z - sums, whitened) of the rows."""
    top = w.n * size(z) + max((abs(int(t)) for t in w.total), default=0)
    away = exact(z, top) * w.n - (w.total if top >= 1 << 62 else w.total.astype(np.int64))
    return away, ((away / w.n).astype(np.float64) @ w.components.T) / np.sqrt(w.values)


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """(id, deviation, whitened array<double>) of rows (id, v); deviation = the sum of (n z - sums)^2."""
    given = rows.select("id", "v")
    shared = rows.sparkSession.sparkContext.broadcast(w)
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            away, white = _apply(matrix(batch.column(1), len(w.total)), w)
            square = exact(away, size(away) ** 2 * max(1, len(w.total)))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_longs((square * square).sum(axis=1)),
                                              pa.array(list(white), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return in_arrow(given, run, f"id {kind}, deviation long, whitened array<double>")


def _spread(batches: Iterator[pa.RecordBatch], w: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(w.values)
    product, total = np.zeros((k, k)), np.zeros(k)
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            _, white = _apply(matrix(batch.column(0).slice(i, STEP), len(w.total)), w)
            product += white.T @ white
            total += white.sum(axis=0)
    i, j = np.triu_indices(k)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, range(k)).astype(np.int32)), pa.array(np.append(j, [-1] * k).astype(np.int32)),
                                      pa.array(np.append(product[i, j], total))], names=["i", "j", "total"])


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    k = len(w.values)
    shared = rows.sparkSession.sparkContext.broadcast(w)
    product, mean = np.zeros((k, k)), np.zeros(k)
    for r in sums_of(in_arrow(rows.select("v"), lambda it: _spread(it, shared.value), "i int, j int, total double"), ["i", "j"], ["total"]):
        if r["j"] < 0:
            mean[r["i"]] = r["total"] / w.n
        else:
            product[r["i"], r["j"]] = product[r["j"], r["i"]] = r["total"] / w.n
    return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # x = floor(64 c) + 1000000: a shift of all entries leaves n x - S and the covariance as they are
    rows = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SCALE)
    out = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for dim in lengths(rows):
        own = rows.where(F.col("dim") == dim)
        w = fit(own, dim)
        if not len(w.values):
            continue
        share = F.array(*[F.lit(float(e / w.trace)) for e in w.values])
        one = whiten(own, w).select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
        out = out.union(one.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
                                   "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(identity_error(own, w)).alias("identity_error")))
    return out
