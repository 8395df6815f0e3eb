"""Whitening of vectors by an incremental eigendecomposition.

``spectrum`` reads the vectors once.  Every partition keeps the eigenvectors and eigenvalues of its scatter matrix and takes in one
vector at a time: centred on the running mean, it is a rank-one update, whose new eigenvalues are the roots of the secular equation
between the old ones (solved for all at once by rational interpolation within brackets) and whose eigenvectors follow from them
(with the update vector recomputed from the roots, so that they stay orthogonal).  Entries that hardly move and poles that
coincide are deflated.  The partitions' spectra are combined, a bounded number at a time and in rounds, by further rank-one updates: one
for each eigenpair of the other, one for the distance of the means.  ``refine`` is one more pass: the covariance projected on the
combined basis (Rayleigh-Ritz), whose eigenpairs are the components to double precision.  ``whiten`` projects every vector.

What leaves a partition is a matrix of dimension**2 numbers, and one task combines at most ROUND of them; the driver gets one.
Sums of the integers are exact, so the mean is, and every covariance is summed over centred values.

Rows whose vector is null, empty, or holds a null or non-finite entry are left out; so are vectors that have not the commonest number of
entries (ties: the longest).  An empty table gives an empty result.  Null ids and repeated rows are rows like others.  A component
without variance (its eigenvalue at most FLAT of the trace: fewer vectors than dimensions, equal vectors) has a null ``whitened``
and no part in ``identity_error``.  A deviation beyond a long is null; an entry beyond 2**53 / 64 raises.  Only the id and the
vector are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import materialise

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
ROUND = 8
FLAT = 1e-12
STEPS = 60
EPS = float(np.finfo(np.float64).eps)
PARTIAL = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


class Spectrum(NamedTuple):
    """n vectors with these sums; mean (less SHIFT); scatter about the mean: vectors (columns) times values (rising)."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


class Whitening(NamedTuple):
    """n, sums; components as columns by falling eigenvalue; the covariance's trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w**2 / (d - x)) for rising d without ties and w without zeros: roots, and d[j] - root i without cancellation.

    Each root lies between two poles; it is sought as a distance from the nearer one.  A step takes the poles at both ends as they are and
    the rest by value and slope; what leaves the bracket is halved instead.
    """
    k, w2 = len(d), w * w
    top = np.append(d, d[-1] + w2.sum())
    width = np.diff(top)
    middle = 1 + (w2 / (d - (d + width / 2)[:, None])).sum(axis=1)
    left = middle >= 0
    left[-1] = True  # the last interval ends at no pole
    origin = np.where(left, d, top[1:])
    delta = d - origin[:, None]
    ends = np.stack([d - origin, top[1:] - origin])
    low = np.where(left, 0.0, -width / 2)
    high = np.where(left, np.where(middle >= 0, width / 2, width), 0.0)
    x = (low + high) / 2
    below = np.tri(k, dtype=bool)
    for _ in range(STEPS):
        gap = delta - x[:, None]
        part = w2 / gap
        f = 1 + part.sum(axis=1)
        done = np.abs(f) <= 4 * EPS * k * (1 + np.abs(part).sum(axis=1))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        slope = part / gap
        psi = np.where(below, slope, 0).sum(axis=1)
        phi = slope.sum(axis=1) - psi
        a1, a2 = ends - x
        a = (a1 + a2) * f - a1 * a2 * (psi + phi)
        b, c = a1 * a2 * f, f - a1 * psi - a2 * phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        x = np.where(done, x, np.where((new >= low) & (new <= high) & (new != 0), new, (low + high) / 2))
    gap = delta - x[:, None]
    return origin + x, gap


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of  vectors diag(values) vectors' + v v'."""
    w = v @ vectors
    size = float(w @ w)
    tolerance = 8 * EPS * max(float(np.abs(values).max()), size)
    live = np.flatnonzero(np.abs(w) * np.sqrt(size) > tolerance)
    if not len(live):
        return values, vectors
    vectors = vectors.copy()
    if (np.diff(values[live]) <= tolerance).any():
        keep, last = [], live[0]
        for j in live[1:]:
            if values[j] - values[last] <= tolerance:  # equal poles: turn the two so that only one meets the update
                r = np.hypot(w[last], w[j])
                c, s = w[j] / r, w[last] / r
                a, b = vectors[:, last].copy(), vectors[:, j].copy()
                vectors[:, last], vectors[:, j] = c * a - s * b, s * a + c * b
                w[last], w[j] = 0.0, r
            else:
                keep.append(last)
            last = j
        live = np.array([*keep, last])
    d, w = values[live], w[live]
    roots, gap = secular_roots(d, w)
    k = len(d)
    # the update vector for which these roots are exact
    between = d - d[:, None]  # [i, j] = d[j] - d[i]
    at = np.arange(k)
    ratio = np.ones((k, k))
    lower = at[:, None] < at
    ratio[lower] = gap[lower] / between[lower]
    upper = ~lower[:-1]
    ratio[:-1][upper] = gap[:-1][upper] / between[1:][upper]
    exact = np.sqrt(np.abs(ratio.prod(axis=0) * gap[-1])) * np.sign(w)
    turn = exact / gap
    turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
    out = values.copy()
    out[live] = roots
    vectors[:, live] = vectors[:, live] @ turn.T
    if len(live) < len(values):
        order = np.argsort(out, kind="stable")
        out, vectors = out[order], vectors[:, order]
    return out, vectors


def empty(dimension: int) -> Spectrum:
    return Spectrum(0, np.zeros(dimension, np.int64), np.zeros(dimension), np.zeros(dimension), np.eye(dimension))


def take(s: Spectrum, rows: np.ndarray) -> Spectrum:
    """With further vectors, one after another."""
    n, mean, values, vectors = s.n, s.mean, s.values, s.vectors
    for x in (rows - SHIFT).astype(np.float64):
        n += 1
        away = x - mean
        mean = mean + away / n
        if n > 1:
            values, vectors = rank_one(values, vectors, away * np.sqrt((n - 1) / n))
    return Spectrum(n, s.sums + rows.sum(axis=0), mean, values, vectors)


def combine(s: Spectrum, t: Spectrum) -> Spectrum:
    values, vectors = s.values, s.vectors
    for e, u in zip(t.values, t.vectors.T):
        if e > 0:
            values, vectors = rank_one(values, vectors, u * np.sqrt(e))
    n, away = s.n + t.n, t.mean - s.mean
    values, vectors = rank_one(values, vectors, away * np.sqrt(s.n * t.n / n))
    return Spectrum(n, s.sums + t.sums, s.mean + away * (t.n / n), values, vectors)


# --- Spark side -------------------------------------------------------------------------------------------------


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, x (whole numbers) of the rows that remain, and their dimension (0: none)."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ok)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows.select("vec_id", F.lit(None).cast("array<long>").alias("x")).limit(0), 0
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return rows.filter(F.size("v") == common["d"]).select("vec_id", x.alias("x")), common["d"]


def _matrix(col: pa.Array, dimension: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _fold(parts: DataFrame, merge: Callable[[pa.Table], list[pa.Array]]) -> pa.RecordBatch | None:
    """``merge`` over at most ROUND rows at a time, until one is left."""
    parts = materialise(parts.withColumn("part", F.spark_partition_id().cast("long")), "parts")
    schema, n = parts.schema, parts.count()

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([table.column("part").combine_chunks().slice(0, 1), *merge(table)], names=table.schema.names)

    while n > 1:
        parts = parts.groupBy(F.floor(F.col("part") / ROUND).alias("_g")).applyInArrow(run, schema)
        parts = materialise(parts.withColumn("part", F.floor(F.col("part") / ROUND)), "parts")
        n = parts.count()
    table = parts.toArrow()
    return table.to_batches()[0] if table.num_rows else None


def spectrum(x: DataFrame, dimension: int) -> Spectrum:
    """Combined spectrum of all vectors."""
    def read(t: pa.Table | pa.RecordBatch, i: int) -> Spectrum:
        n, sums, mean, values, vectors = (t.column(c)[i].as_py() for c in ("n", "sums", "mean", "values", "vectors"))
        return Spectrum(n, np.array(sums, np.int64), np.array(mean), np.array(values), np.array(vectors).reshape(dimension, dimension))

    def write(s: Spectrum) -> list[pa.Array]:
        one = lambda v, kind: pa.array([v.reshape(-1).tolist()], pa.list_(kind))
        return [pa.array([s.n], pa.int64()), one(s.sums, pa.int64()), one(s.mean, pa.float64()), one(s.values, pa.float64()), one(s.vectors, pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = empty(dimension)
        for b in batches:
            s = take(s, _matrix(b.column(0), dimension))
        if s.n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *write(s)], ["part", "n", "sums", "mean", "values", "vectors"])

    def merge(t: pa.Table) -> list[pa.Array]:
        s = read(t, 0)
        for i in range(1, t.num_rows):
            s = combine(s, read(t, i))
        return write(s)

    got = _fold(x.select("x").mapInArrow(run, PARTIAL), merge)
    return read(got, 0) if got is not None else empty(dimension)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _covariance(x: DataFrame, dimension: int, values_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Covariance (divisor n, centred before multiplying) of ``values_of`` the vectors, ``width`` numbers each."""
    def write(n: int, mean: np.ndarray, about: np.ndarray) -> list[pa.Array]:
        one = lambda v: pa.array([v.reshape(-1).tolist()], pa.list_(pa.float64()))
        return [pa.array([n], pa.int64()), one(mean), one(about)]

    def join(s, t):
        n, away = s[0] + t[0], t[1] - s[1]
        return n, s[1] + away * (t[0] / n), s[2] + t[2] + np.outer(away, away) * (s[0] * t[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for b in batches:
            if b.num_rows:
                v = values_of(_matrix(b.column(0), dimension))
                mean = v.mean(axis=0)
                t = (len(v), mean, (v - mean).T @ (v - mean))
                s = t if s is None else join(s, t)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *write(*s)], ["part", "n", "mean", "about"])

    def read(t, i):
        return t.column("n")[i].as_py(), np.array(t.column("mean")[i].as_py()), np.array(t.column("about")[i].as_py()).reshape(width, width)

    def merge(t: pa.Table) -> list[pa.Array]:
        s = read(t, 0)
        for i in range(1, t.num_rows):
            s = join(s, read(t, i))
        return write(*s)

    n, _, about = read(_fold(x.select("x").mapInArrow(run, "part long, n long, mean array<double>, about array<double>"), merge), 0)
    return about / n


def refine(x: DataFrame, s: Spectrum) -> Whitening:
    """Rayleigh-Ritz on the whole basis of the incremental spectrum: components to double precision."""
    n, sums, dimension = s.n, s.sums, len(s.mean)
    basis = np.linalg.qr(s.vectors)[0]
    projected = _covariance(x, dimension, lambda v: centred(v, n, sums) @ basis, dimension)
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    vectors = basis @ turn[:, ::-1]
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dimension)] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, values[::-1], float(np.trace(projected)))


def whiten(x: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and component."""
    n, sums, dimension = model.n, model.sums, len(model.sums)
    width = min(components, dimension)
    values = model.values[:width]
    flat = ~(values > FLAT * model.trace)
    scale = 1 / np.sqrt(np.where(flat, 1.0, values))
    basis = model.vectors[:, :width]
    explained = values / model.trace if model.trace > 0 else np.zeros(width)
    project = lambda v: (centred(v, n, sums) @ basis) * scale
    used = np.flatnonzero(~flat)
    error = float(np.abs(_covariance(x, dimension, lambda v: project(v)[:, used], len(used)) - np.eye(len(used))).max()) if len(used) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), dimension)
            rows = len(v)
            away = n * v - sums
            rough = (away.astype(np.float64) ** 2).sum(axis=1)
            deviation = (away * away).sum(axis=1).tolist()
            for i in np.flatnonzero(rough > 2.0 ** 60).tolist():
                exact = sum(int(a) ** 2 for a in away[i])
                deviation[i] = exact if exact < 2 ** 63 else None
            w = pa.array(project(v).reshape(-1), mask=np.tile(flat, rows) if flat.any() else None)
            each = pa.array(np.repeat(np.arange(rows), width))
            fixed = lambda a: pa.array(np.tile(a, rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), fixed(np.arange(1, width + 1, dtype=np.int32)), pa.array(np.full(rows * width, n, np.int64)),
                 pa.array(deviation, pa.int64()).take(each), w, fixed(explained), pa.array(np.full(rows * width, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The whole operator on a table of vectors."""
    x, dimension = integers(df, vec_id, vector)
    if not dimension:
        return whiten(x.limit(0), Whitening(1, np.zeros(1, np.int64), np.eye(1), np.zeros(1), 0.0), components)
    return whiten(x, refine(x, spectrum(x, dimension)), components)
