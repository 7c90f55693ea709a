"""Embedding whitening by incremental eigendecomposition.

Every remaining entry c becomes the integer x = floor(1024 c) + 100000. One pass over the partitions keeps, per task, the
exact count and sums of x and a spectrum (mean, eigenvalues, eigenvectors of the scatter about the mean). A block of
vectors enters it as centred rank-one updates: the rows of the triangular factor of the centred block, which have the
block's scatter, and one for the shift of the mean; so a block of any size costs d + 1 updates. Each update solves the
secular equation of diag(e) + rho z z', after deflating zero components and close eigenvalues, and rebuilds the
eigenvectors from the roots. Spectra of tasks are combined in a tree of groups of ``FAN_IN``, again by rank-one updates,
one for each eigenpair and one for the means. The combined eigenvectors are the basis of a Rayleigh-Ritz pass over all
vectors: the projected covariance, summed by task and in the same tree, turns them to the eigenvectors of the exactly centred
covariance. What reaches the driver is one spectrum and two small matrices.

Defined cases: a null vector and a vector with a null or non-finite entry are dropped; so are vectors of another length than
the commonest (of equally common lengths the smallest), and empty ones. Directions without variance (below 1e-12 of the
trace) cannot be whitened and give no component, so one vector or equal vectors give no rows. Repeated rows and keys
each count and return; a null key is returned. A deviation beyond a long is null. |1024 c| is cut at 2^62. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS, FAN_IN, FLAT = 8, 16, 1e-12
EPS = np.finfo(float).eps


def roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1/rho + sum z2 / (d - x) = 0 for rising ``d``, as (pole index, distance from that pole).

    Root i lies between d[i] and d[i + 1]. It is searched from the nearer of both poles, by fitting one pole to the terms on
    either side (value and slope) and solving the fitted equation; steps that leave the bracket are halvings.
    """
    k = len(d)
    top = d[-1] + rho * z2.sum()
    upper = np.append(d[1:], top)
    middle = (d + upper) / 2
    at_middle = 1 / rho + (z2 / (d[None, :] - middle[:, None])).sum(1)
    origin = np.arange(k)
    origin[:-1] += at_middle[:-1] <= 0
    gaps = d[None, :] - d[origin][:, None]
    a, b = d - d[origin], upper - d[origin]
    lo, hi = np.where(at_middle > 0, a, middle - d[origin]), np.where(at_middle > 0, middle - d[origin], b)
    x = (lo + hi) / 2
    left = np.tri(k, dtype=bool)
    for _ in range(80):
        away = gaps - x[:, None]
        terms = z2 / away
        slopes = terms / away
        psi, phi = np.where(left, terms, 0).sum(1), np.where(left, 0, terms).sum(1)
        f = 1 / rho + psi + phi
        done = (np.abs(f) <= 4 * k * EPS * (1 / rho + np.abs(psi) + np.abs(phi))) | (hi - lo <= 2 * EPS * np.abs(x))
        if done.all():
            break
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        dpsi, dphi = np.where(left, slopes, 0).sum(1), np.where(left, 0, slopes).sum(1)
        s, t = dpsi * (a - x) ** 2, dphi * (b - x) ** 2
        c = 1 / rho + psi - dpsi * (a - x) + phi - dphi * (b - x)
        p, q = c * (a + b) + s + t, c * a * b + s * b + t * a
        with np.errstate(all="ignore"):
            w = p + np.copysign(np.sqrt(np.maximum(p * p - 4 * c * q, 0)), p)
            one, two = 2 * q / w, w / (2 * c)
            one[-1] = a[-1] + s[-1] / c[-1]
        inside = lambda v: np.isfinite(v) & (v > lo) & (v < hi)  # noqa: E731, B023
        step = np.where(inside(one), one, np.where(inside(two), two, (lo + hi) / 2))
        x = np.where(done, x, step)
    return origin, x


def updated(e: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of ``u diag(e) u' + rho v v'`` for rho > 0."""
    size = float(np.sqrt(rho) * np.linalg.norm(v))
    if size == 0:
        return e, u
    z = (u.T @ v) * (np.sqrt(rho) / size)
    weight = size * size
    scale = max(np.abs(e).max(initial=0), weight)
    # Deflation: components that do not move anything, then all but one of eigenvalues that cannot be told apart.
    z[weight * np.abs(z) <= 8 * EPS * scale] = 0
    live = np.flatnonzero(z)
    for i, j in zip(live[:-1], live[1:], strict=True):
        if e[j] - e[i] <= 8 * EPS * scale:
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            z[i], z[j] = 0, r
            u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
    live = np.flatnonzero(z)
    if len(live) == 0:
        return e, u
    d, zl = e[live], z[live]
    origin, x = roots(d, zl * zl, weight)
    # Distances of roots from poles, from which the components are recomputed so that the vectors are orthogonal.
    apart = x[:, None] - (d[None, :] - d[origin][:, None])
    poles = d[:, None] - d[None, :]
    np.fill_diagonal(poles, 1)
    fitted = np.copysign(np.sqrt(np.abs(np.prod(apart / poles, axis=0))), zl)
    turned = (fitted / apart).T
    turned /= np.linalg.norm(turned, axis=0)
    e, u = e.copy(), u.copy()
    e[live] = d[origin] + x
    u[:, live] = u[:, live] @ turned
    order = np.argsort(e, kind="stable")
    return e[order], u[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean and the eigenpairs of the scatter about it."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.zeros(d), np.zeros(d), np.eye(d))

    def shift(self, n: int, mean: np.ndarray) -> None:
        gap = mean - self.mean
        if self.n:
            self.values, self.vectors = updated(self.values, self.vectors, gap, self.n * n / (self.n + n))
        self.mean = self.mean + gap * (n / (self.n + n))
        self.n += n

    def add(self, x: np.ndarray) -> None:
        """Append a block of integer vectors."""
        high, low = (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0)
        self.sums = [s + (int(h) << 31) + int(k) for s, h, k in zip(self.sums, high, low, strict=True)]
        y = x.astype(float)
        mean = y.mean(0)
        for row in np.linalg.qr(y - mean, mode="r"):
            self.values, self.vectors = updated(self.values, self.vectors, row)
        self.shift(len(x), mean)

    def join(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = updated(self.values, self.vectors, vector, float(value))
        self.shift(other.n, other.mean)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]


def vectors(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the remaining rows of (key, vector) and their integers."""
    column = batch.column(1)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == d)
    entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    fine = np.isfinite(entries).all(1)
    return rows[fine], np.clip(np.floor(entries[fine] * SCALE), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def states(df: DataFrame, start: Callable[[], object], add: Callable[[object, np.ndarray], None], d: int, name: str) -> DataFrame:
    """One state for each task that has vectors, as Arrow-free bytes, written to the shared folder."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_row, part = start(), False, 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows and not any_row else part
            rows, x = vectors(batch, d)
            if len(rows):
                add(state, x)
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    return stored(df.select(F.spark_partition_id().cast("long"), F.col(df.columns[1])).mapInArrow(run, "part long, state binary"), name)


def joined(parts: DataFrame, join: Callable[[object, object], None], name: str) -> object | None:
    """Combine stored states in a tree of ``FAN_IN``; the last one, or null."""
    import pickle

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        state = pickle.loads(group.state.iloc[0])
        for other in group.state.iloc[1:]:
            join(state, pickle.loads(other))
        return pd.DataFrame({"part": [int(group.part.iloc[0]) // FAN_IN], "state": [pickle.dumps(state)]})

    while parts.count() > 1:
        parts = stored(parts.groupBy(F.floor(F.col("part") / FAN_IN).cast("long").alias("team")).applyInPandas(
            lambda g: merge(g), "part long, state binary"), name)
    last = parts.head()
    return pickle.loads(last.state) if last else None


@dataclass(frozen=True)
class Model:
    """Exact count and sums, unit eigenvectors by falling eigenvalue, eigenvalues and trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in Python integers where longs would not hold it."""
        wide = max(np.abs(x).max(initial=0), max(abs(s) for s in self.sums) // max(self.n, 1) + 1)
        if int(wide) * self.n < 2**61:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whiten(self, gaps: np.ndarray) -> np.ndarray:
        return (gaps.astype(float) / self.n) @ self.components / np.sqrt(self.values)


def deviations(gaps: np.ndarray) -> list[int | None]:
    about = (gaps.astype(float) ** 2).sum(1)
    if gaps.dtype != object and about.max(initial=0) < 2.0**62:
        return (gaps * gaps).sum(1).tolist()
    exact = [sum(int(g) * int(g) for g in row) for row in gaps]
    return [v if v < 2**63 else None for v in exact]


def sane(vector: Column) -> Column:
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of ``rows`` (key, vector of doubles), or null without a vector or variance."""
    key, vector = rows.columns
    length = (rows.where(sane(F.col(f"`{vector}`"))).groupBy(F.size(f"`{vector}`").alias("d")).count().where("d > 0")
              .orderBy(F.desc("count"), "d").select("d").head())
    if length is None:
        return None
    d = length.d
    spectrum = joined(states(rows, lambda: Spectrum.empty(d), Spectrum.add, d, "whitening-spectra"), Spectrum.join, "whitening-spectra")
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    first = Model(spectrum.n, tuple(spectrum.sums), basis, np.ones(d), 0.0)

    def gram(state: np.ndarray, x: np.ndarray) -> None:
        y = first.whiten(first.gaps(x))
        state += y.T @ y

    projected = joined(states(rows, lambda: np.zeros((d, d)), gram, d, "whitening-projected"), np.ndarray.__iadd__, "whitening-projected") / first.n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    trace = float(np.trace(projected))
    kept = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > FLAT * trace]
    return Model(first.n, first.sums, basis @ turn[:, kept], values[kept], trace) if kept else None


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error for every remaining row and component."""
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{vector}`").cast("array<double>").alias("vector" if key.lower() != "vector" else "entries"))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    d, k = len(model.sums), len(model.values)

    def spread(state: np.ndarray, x: np.ndarray) -> None:
        y = model.whiten(model.gaps(x))
        state[0] += y.sum(0)
        state[1:] += y.T @ y

    sums = joined(states(rows, lambda: np.zeros((k + 1, k)), spread, d, "whitening-spread"), np.ndarray.__iadd__, "whitening-spread") / model.n
    error = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(k)).max())
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors(batch, d)
            if not len(at):
                continue
            gaps = model.gaps(x)
            m = len(at) * k
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                pa.array(np.full(m, model.n)), pa.array(np.repeat(np.array(deviations(gaps), dtype=object), k), pa.int64()),
                pa.array(model.whiten(gaps).ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(m, error)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
