"""Whitening of embeddings: moments are merged pairwise over a tree, the driver solves one small eigenproblem.

Each partition computes count, exact sums, local mean and centred scatter in blocks; Chan's formula merges two such
states without subtracting large numbers from each other. A second pass over the data computes the moments of the
whitened values in the same way and so verifies that their covariance is the identity.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000  # x = floor(SCALE * c) + SHIFT
MOST = 1 << 62
BLOCK = 4096
COMPONENTS = 8


@dataclass
class Moments:
    """n vectors: their exact sums (Python integers, or None), mean and scatter about it."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray


def moments(x: np.ndarray) -> Moments:
    """Of a block of rows, integers (with exact sums) or doubles."""
    exact = x.dtype.kind == "i"
    wide = exact and len(x) and max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= MOST
    sums = [int(s) for s in (x.astype(object) if wide else x).sum(0)] if exact else None
    mean = np.array([s / len(x) for s in sums]) if exact else x.mean(0)
    centred = x - mean
    return Moments(len(x), sums, mean, centred.T @ centred)


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's pairwise formula."""
    if a is None or b is None:
        return b if a is None else a
    n, apart = a.n + b.n, b.mean - a.mean
    sums = None if a.sums is None else [x + y for x, y in zip(a.sums, b.sums, strict=True)]
    mean = a.mean + apart * (b.n / n) if sums is None else np.array([s / n for s in sums])
    return Moments(n, sums, mean, a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def _vectors(batches, dimension: int):
    """vec_ids and x of the rows in blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), np.asarray(part.column(1).flatten()).reshape(-1, dimension)


def _tree(rows: DataFrame, state_of, dimension: int, depth: int) -> Moments | None:
    """One state a partition, merged over a tree of tasks."""

    def states(batches):
        state = None
        for _, x in _vectors(batches, dimension):
            state = merged(state, state_of(x))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def load(row):
        return pickle.loads(bytes(row.state))

    partials = rows.mapInArrow(states, "state binary").rdd.map(load)
    return partials.treeReduce(merged, depth) if partials.getNumPartitions() else None


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the integer vectors of rows that take part."""
    e = F.col("embedding")
    scaled = F.transform(e, lambda c: F.floor(F.when(F.abs(c.cast("double")) < MOST / SCALE / 2, c.cast("double") * SCALE)) + F.lit(SHIFT))
    fit = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < MOST / SCALE / 2))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<long>").alias("x"))


@dataclass(frozen=True)
class Whitening:
    """What `fit` learns: mean and sums of x, and the components with their eigenvalues and shares, columns by rank."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; a direction without variance gives 0."""
        flat = self.values <= 0
        out = ((x - self.mean) @ self.vectors) / np.sqrt(np.where(flat, 1.0, self.values))
        return np.where(flat, 0.0, out)


def fit(rows: DataFrame, dimension: int, components: int = COMPONENTS, depth: int = 2) -> Whitening | None:
    """From the rows of `usable`, all of one dimension."""
    m = _tree(rows, moments, dimension, depth)
    if m is None:
        return None
    v = (m.scatter + m.scatter.T) / (2 * m.n)
    values, vectors = np.linalg.eigh(v)
    trace = float(np.trace(v))
    top = min(components, dimension)
    values, vectors = values[::-1][:top].copy(), vectors[:, ::-1][:, :top]
    values[values <= trace * 1e-14 * dimension] = 0  # what rounding leaves where nothing varies
    return Whitening(m.n, m.sums, m.mean, vectors, values, values / trace if trace > 0 else np.zeros(top))


def identity_error(rows: DataFrame, w: Whitening, dimension: int, depth: int = 2) -> float:
    """The largest absolute entry of the whitened values' covariance minus the identity, over the components that
    vary, from a pass over all rows."""
    varies = w.values > 0
    m = _tree(rows, lambda x: moments(w(x)[:, varies]), dimension, depth)
    return float(np.abs(m.scatter / m.n - np.eye(int(varies.sum()))).max(initial=0.0))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum((n * x - S)^2) a row, exact: in 64 bits where all fits, else in Python's integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if most < MOST:
        d = x * n - np.array(sums, np.int64)
        far = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
        if far * far * x.shape[1] < MOST:
            return (d * d).sum(1).tolist()
        d = d.astype(object)
    else:
        d = x.astype(object) * n - np.array(sums, object)
    return [int(s) for s in (d * d).sum(1)]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def _projected(w: Whitening, dimension: int, error: float):
    def run(batches):
        k = len(w.values)
        for ids, x in _vectors(batches, dimension):
            rows = len(x)
            exact = deviations(x, w.n, w.sums)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, w.n, np.int64)),
                    pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()).take(pa.array(each)),
                    pa.array(w(x).ravel()),
                    pa.array(np.tile(w.explained, rows)),
                    pa.array(np.full(rows * k, error)),
                    pa.array([str(d) for d in exact]).take(pa.array(each)),
                ],
                [c.split()[0] for c in _OUT.split(", ")],
            )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, depth: int = 2) -> DataFrame:
    """vec_id, embedding of any rows -> a row per usable row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error, deviation_exact.

    Rows whose vector is null or empty, or holds null or non-finite entries, or entries beyond about 2^51 (their x would
    pass 64 bits) take no part, nor do vectors of another length than most have (of equally many, the shorter).
    Repeated rows and ids count and come out each. A direction without variance (one row, equal rows) whitens to 0,
    explains 0 and is no part of identity_error. `deviation` is null where it passes 64 bits; `deviation_exact`
    (a decimal, null beyond 38 digits) holds it then. Without usable rows the result is empty.
    """
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    w = None
    if lengths is not None:
        rows = rows.where(F.size("x") == lengths.d)
        w = fit(rows, lengths.d, components, depth)
    exact = F.col("deviation_text").try_cast("decimal(38,0)").alias("deviation_exact")
    if w is None:
        out = vectors.sparkSession.createDataFrame([], _OUT)
    else:
        out = rows.mapInArrow(_projected(w, lengths.d, identity_error(rows, w, lengths.d, depth)), _OUT)
    return out.select(*(c.split()[0] for c in _OUT.split(", ")[:-1]), exact)
