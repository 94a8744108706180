"""Whitening of embeddings by leading eigenvectors, found by contour integration (the FEAST method).

Spark folds the vectors to exact sums and to the covariance, whose size depends on the dimensions only. Inertia counts (the
signs of the pivots of the shifted covariance, after it is made tridiagonal) cut the spectrum into intervals of few
eigenvalues. For each interval a subspace is filtered by Gauss-Legendre quadrature on the circle over it: every (interval,
node) pair is one task that solves a complex shifted system. Rayleigh-Ritz takes the eigenvectors out of the filtered
subspace; an interval is done when it holds as many Ritz values as its inertia count and their residuals are at rounding.
A last pass over the vectors measures the covariance of what is returned.

Defined results: a row whose vector is null or empty or holds null or non-finite entries is left out; a null id stays null;
repeated rows count as often as they occur; vectors of different lengths, or entries of 2**46 or more in size, are an error;
directions without variance (to rounding) have no component, so one vector, equal vectors or an empty table give no rows;
other columns of the table are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LIMIT = 2.0 ** 46
NODES = 8  # quadrature nodes on the upper half of each circle
HELD = 8  # eigenvalues that an interval holds at most, unless they are too close to be cut apart
ROUNDS = 40
STEP = 4096  # vectors worked on at once
OUT = "id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Unfinished(RuntimeError):
    """An interval did not yield as many eigenvectors as its inertia count."""


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the usable rows of a batch (id, v), and their whole-number vectors as doubles."""
    lists = batch.column(1)
    if pa.types.is_fixed_size_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    flat = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~np.isfinite(flat), out=bad[1:])
    rows = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    if not len(rows):
        return rows, np.zeros((0, 0))
    d = int(sizes[rows[0]])
    if (sizes[rows] != d).any():
        raise ValueError("vectors of different lengths")
    x = flat[(ends[rows] - d)[:, None] + np.arange(d)]
    if (np.abs(x) >= LIMIT).any():
        raise ValueError("an entry is too large for the exact sums")
    return rows, np.floor(SCALE * x) + SHIFT


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            rows, x = vectors(part)
            if len(rows):
                yield part, rows, x


def first_moments(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension; both stay small however many vectors there are."""
    def fold(batches):
        n, total = 0, None
        for _, _, x in _stretches(batches):
            part = [int(v) for v in x.astype(np.int64).sum(axis=0)]
            if total is not None and len(total) != len(part):
                raise ValueError("vectors of different lengths")
            n, total = n + len(x), part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({
                "size": pa.array([len(total)] * len(total), pa.int32()), "i": pa.array(range(len(total)), pa.int32()),
                "n": pa.array([n] * len(total), pa.int64()), "s": pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))})

    sums = rows.mapInArrow(fold, "size int, i int, n long, s decimal(38,0)").groupBy("size", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    if len({r["size"] for r in sums}) > 1:
        raise ValueError("vectors of different lengths")
    return (sums[0]["n"], [int(r["s"]) for r in sums]) if sums else (0, [])


def _products(rows: DataFrame, size: int, project) -> np.ndarray:
    """Sum over all vectors of the products of the ``size`` numbers that ``project`` makes of each, entry by entry."""
    upper = np.triu_indices(size)

    def fold(batches):
        total = np.zeros((size, size))
        for _, _, x in _stretches(batches):
            y = project(x)
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "v": total[upper]})

    out = np.zeros((size, size))
    for r in rows.mapInArrow(fold, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the eigenvalues of ``v`` (Householder)."""
    a, d = np.array(v, float), len(v)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += math.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ x
        q = p - (x @ p) * x
        rest -= 2 * (np.outer(x, q) + np.outer(q, x))
        a[k + 1:, k] -= 2 * x * (x @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def inertia(diagonal: np.ndarray, squares: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below ``shift``: negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot, count = diagonal[0] - shift, 0
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - shift - squares[i - 1] / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return int(count)


class Spectrum:
    """Inertia counts of one covariance and the intervals cut by them."""

    def __init__(self, v: np.ndarray):
        self.size = len(v)
        self.diagonal, self.squares = tridiagonal(v)
        side = np.sqrt(self.squares)
        reach = np.abs(self.diagonal) + np.append(side, 0) + np.append(0, side)
        self.top = float(reach.max()) * (1 + 1e-6) if self.size else 0.0
        self.tol = self.top * 1e-11

    def above(self, shift: float) -> int:
        return self.size - inertia(self.diagonal, self.squares, shift)

    def _edge(self, inside: float, outside: float, count: int) -> float:
        """The eigenvalue next to ``inside`` on the way to ``outside``, where the count of eigenvalues above differs."""
        for _ in range(48):
            at = (inside + outside) / 2
            inside, outside = (at, outside) if self.above(at) == count else (inside, at)
        return inside

    def cut(self, low: float, high: float) -> float:
        """The middle of the gap between eigenvalues that holds the middle of the two places."""
        at = (low + high) / 2
        count = self.above(at)
        return (self._edge(at, -self.tol, count) + self._edge(at, self.top, count)) / 2

    def leading(self, wanted: int) -> list[tuple[float, float, int]]:
        """Intervals (low, high, eigenvalues inside) that together hold the ``wanted`` largest eigenvalues."""
        floor = 2 * self.tol
        wanted = min(wanted, self.above(floor))
        if wanted == 0:
            return []
        low, high = floor, self.top
        while self.above(low) > wanted + HELD // 2 and high - low > self.top * 1e-8:
            at = (low + high) / 2
            low, high = (at, high) if self.above(at) >= wanted else (low, at)
        low = self.cut(low, low)
        out, open_ = [], [(low, self.top)]
        while open_:
            a, b = open_.pop()
            inside = self.above(a) - self.above(b)
            if inside <= HELD or b - a < self.top * 1e-6:
                if inside:
                    out.append((a, b, inside))
                continue
            at = self.cut(a, b)
            if not a < at < b or self.above(at) in (self.above(a), self.above(b)):
                at = (a + b) / 2
            open_ += [(a, at), (at, b)]
        return sorted(out)


def _filtered(spark: SparkSession, v: np.ndarray, work: list[tuple[int, float, float, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each (number, low, high, subspace): the subspace times the quadrature of the resolvent over the interval's circle."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    shared = spark.sparkContext.broadcast((v, {k: y for k, _, _, y in work}))
    tasks = [(k, e, (a + b) / 2, (b - a) / 2, math.pi / 2 * (1 - points[e]), weights[e]) for k, a, b, _ in work for e in range(NODES)]

    def solve(batches):
        matrix, subspaces = shared.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                k, node, middle, radius, angle, weight = tasks[number]
                turn = radius * complex(math.cos(angle), math.sin(angle))
                system = (middle + turn) * np.eye(len(matrix)) - matrix
                part = weight / 2 * (turn * np.linalg.solve(system, subspaces[k].astype(complex))).real
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "node": pa.array([node], pa.int32()),
                                                  "part": pa.array([part.ravel()], pa.list_(pa.float64()))})

    frame = spark.range(0, len(tasks), 1, len(tasks))
    out = {k: np.zeros_like(y) for k, _, _, y in work}
    for r in sorted(frame.mapInArrow(solve, "k int, node int, part array<double>").collect(), key=lambda r: (r["k"], r["node"])):
        out[r["k"]] += np.array(r["part"]).reshape(out[r["k"]].shape)
    shared.unpersist()
    return out


def _ritz(v: np.ndarray, subspace: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, sizes, _ = np.linalg.svd(subspace, full_matrices=False)
    basis = left[:, sizes > sizes[0] * 1e-13] if sizes[0] > 0 else left[:, :1]
    inner = basis.T @ v @ basis
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    return values, basis @ turned


def leading_components(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``v``, falling, and their unit eigenvectors as columns; fewer if ``v`` has less rank."""
    spectrum, rng = Spectrum(v), np.random.default_rng(7)
    intervals = spectrum.leading(wanted)
    if not intervals:
        return np.zeros(0), np.zeros((len(v), 0))
    found: dict[int, np.ndarray] = {}
    near: dict[int, tuple[float, np.ndarray]] = {}
    space = {k: rng.standard_normal((len(v), min(len(v), inside + inside // 2 + 6))) for k, (_, _, inside) in enumerate(intervals)}
    for _ in range(ROUNDS):
        work = [(k, *intervals[k][:2], space[k]) for k in range(len(intervals)) if k not in found]
        if not work:
            break
        for k, filtered in _filtered(spark, v, work).items():
            low, high, inside = intervals[k]
            values, turned = _ritz(v, filtered)
            chosen = (values >= low - spectrum.tol) & (values <= high + spectrum.tol)
            left = float(np.abs(v @ turned[:, chosen] - turned[:, chosen] * values[chosen]).max()) if chosen.any() else math.inf
            space[k] = turned
            if chosen.sum() != inside or left > spectrum.top * 1e-12:
                near.pop(k, None)
            elif left <= spectrum.top * 4e-16 or (k in near and left > near[k][0] / 2):
                found[k] = turned[:, chosen] if k not in near or left <= near[k][0] else near[k][1]
            else:
                near[k] = (left, turned[:, chosen])
    if len(found) < len(intervals):
        raise Unfinished("eigenvalues are missing: " + str([intervals[k] for k in range(len(intervals)) if k not in found]))
    values, turned = _ritz(v, np.hstack([found[k] for k in sorted(found)]))
    if len(values) != sum(i[2] for i in intervals):
        raise Unfinished("eigenvectors of different intervals agree")
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], turned[:, order]


def whiten(df: DataFrame, components: int = 32, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: number of vectors, squared deviation, whitened value, explained share, error."""
    spark = df.sparkSession
    rows = df.select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    schema = OUT.format(id=rows.schema["id"].dataType.simpleString())
    n, sums = first_moments(rows)
    size = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], float) if n else np.zeros(0)
    shift = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)]) if n else np.zeros(0)
    v = _products(rows, size, lambda x: x - centre) / n - np.outer(shift, shift) if n else np.zeros((0, 0))
    values, turned = leading_components(spark, v, components) if n else (np.zeros(0), np.zeros((0, 0)))
    count = len(values)
    if not count:
        return spark.createDataFrame([], schema)
    scaled = turned / np.sqrt(values)
    project = lambda x: (x - centre - shift) @ scaled
    own = _products(rows, count + 1, lambda x: np.hstack([project(x), np.ones((len(x), 1))])) / n
    mean = own[:count, count]
    error = float(np.abs(own[:count, :count] - np.outer(mean, mean) - np.eye(count)).max())
    explained = values / np.trace(v)
    offset = [n * int(c) - s for s, c in zip(sums, centre, strict=True)]

    def write(batches):
        for part, picked, x in _stretches(batches):
            y = x - centre
            if size * (n * (float(np.abs(y).max()) + 1)) ** 2 < 2.0 ** 62:
                far = ((n * y.astype(np.int64) + np.array(offset, np.int64)) ** 2).sum(axis=1)
                far = pa.array(np.repeat(far, count), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                far = [Decimal(sum((n * int(a) + o) ** 2 for a, o in zip(r, offset, strict=True))) for r in y]
                far = pa.array([f for f in far for _ in range(count)], pa.decimal128(38, 0))
            k = len(picked)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(picked, count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), k)),
                pa.array(np.full(k * count, n)), far, pa.array(project(x).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * count, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(write, schema)


def embedding_whitening(df: DataFrame) -> DataFrame:
    """The table of the query: 32 components; ``deviation`` as long, an error where it does not fit."""
    return whiten(df).select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
