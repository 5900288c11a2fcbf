"""Exact top-k by inner product with pivot-table elimination.

Distances of every vector to a set of pivots are computed once. For a query q and a candidate c the largest
|d(q, p) - d(c, p)| over the pivots is a lower bound of d(q, c), which bounds the inner product from above:
2 q.c = |q|^2 + |c|^2 - d(q, c)^2. Candidates are evaluated in the order of their bounds until the bound
falls below the k-th best score so far; the rest are never evaluated, and the result is exact.

Query blocks lie in the shared folder; each task holds a block of candidates and streams them past it. A query
starts with the k-th best score of a bounded sample.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, work_path

SCALE = 1024
PIVOTS = 24
SAMPLE = 512
BLOCK = 4096  # queries
HELD = 32_768  # candidates at a time, fewer if they are wide
HELD_BYTES = 64 << 20
STEP = 128


def _rows(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimension: (ids, integer vectors)} of the usable rows of a batch of (vec_id, embedding)."""
    found: dict[int, tuple[list, list]] = {}
    ids, vectors = batch.column(0), batch.column(1)
    for i, v in zip(ids.to_pylist(), vectors, strict=True):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(x).all():
            continue
        at = found.setdefault(len(x), ([], []))
        at[0].append(i)
        at[1].append(np.floor(x * SCALE))
    return {d: (np.array(i, np.int64), np.array(v, np.float64).reshape(len(v), d)) for d, (i, v) in found.items()}


def scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of c with q, whose values are whole numbers."""
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1)
    if most < 2.0**53:
        return (c @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in c]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(2), 0)) if len(x) <= 256 else np.concatenate([distances(x[a : a + 256], pivots) for a in range(0, len(x), 256)])


def pick_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Far apart: each next pivot is the sample vector farthest from those chosen."""
    if not len(x):
        return x
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _queries(sample: dict, k: int, block: int):
    """Blocks of queries: dim, block, ids, vectors, and each one's first bound, the k-th best score in the sample."""

    def run(batches):
        for d, ids, x in _blocks(batches, block):
            near_ids, near = sample.get(d, (np.empty(0, np.int64), np.zeros((0, d))))
            start = []
            for qi, q in zip(ids, x, strict=True):
                s = np.sort(scores(near, q)[near_ids != qi]) if len(near) else np.empty(0, np.int64)
                start.append(int(s[-k]) if len(s) >= k else -(2**63))
            row = [d, uuid.uuid4().hex, ids.tobytes(), x.tobytes(), np.array(start, np.int64).tobytes()]
            kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["dim", "block", "ids", "vectors", "start"])

    return run


def _blocks(batches, rows: int):
    """(dimension, ids, vectors) of up to `rows` rows and HELD_BYTES of one dimension at a time."""
    held: dict[int, list] = {}
    for batch in batches:
        for d, found in _rows(batch).items():
            held.setdefault(d, []).append(found)
            if (n := sum(len(i) for i, _ in held[d])) >= rows or n * d * 8 >= HELD_BYTES:
                parts = held.pop(d)
                ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                for at in range(0, len(ids), rows):
                    yield d, ids[at : at + rows], x[at : at + rows]
    for d, parts in held.items():
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for at in range(0, len(ids), rows):
            yield d, ids[at : at + rows], x[at : at + rows]


def search(q: np.ndarray, tq: np.ndarray, own: int, start: int, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of at least the query's best k among x that reach `start`."""
    low = np.abs(table - tq).max(1) if table.shape[1] else np.zeros(len(x))
    low = np.maximum(low * (1 - 1e-9) - 1e-6, 0)
    square = float(q @ q)
    bound = (square + norms - low * low) / 2
    bound += 1 + (square + norms) * 1e-9  # rounding never hides a candidate
    order = np.flatnonzero((bound >= start) & (ids != own))
    order = order[np.argsort(-bound[order], kind="stable")]
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(order), STEP):
        if len(best) >= k and bound[order[at]] < best[k - 1]:
            break
        some = order[at : at + STEP]
        best_ids, best = np.concatenate([best_ids, ids[some]]), np.concatenate([best, scores(x[some], q)])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
    fits = best >= start
    return best_ids[fits], best[fits]


def _meet(sample: dict, folder: str, k: int, held: int):
    """Each task holds a block of candidates and streams the query blocks past it, so candidates are never
    shuffled, and of each block at most k rows a query go on."""

    def run(batches):
        pivots = {d: pick_pivots(v, PIVOTS) for d, (_, v) in sample.items()}
        for d, ci, c in _blocks(batches, held):
            p = pivots.get(d, np.zeros((0, d)))
            tc, norms = distances(c, p), (c * c).sum(1)
            for row in _stored(folder, d):
                qi, start = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["start"], np.int64)
                q = np.frombuffer(row["vectors"]).reshape(len(qi), d)
                tq = distances(q, p)
                found = [(np.full(len(i), n), i, s) for n, (own, v, t, b) in enumerate(zip(qi, q, tq, start, strict=True)) for i, s in [search(v, t, own, int(b), ci, c, norms, tc, k)]]
                n, ids, score = (np.concatenate([f[j] for f in found]).astype(np.int64) for j in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(n), pa.string()), pa.array(n), pa.array(qi[n]), pa.array(ids), pa.array(score)], ["block", "n", "query_id", "vec_id", "score"])

    return run


def _stored(folder: str, d: int):
    """The query blocks of a dimension, one at a time, from the shared folder."""
    fs, base = filesystem(folder)
    for part in ds.dataset(base, format="parquet", filesystem=fs).get_fragments():
        for group in part.split_by_row_group():
            for batch in group.to_batches(filter=ds.field("dim") == d, batch_size=1, batch_readahead=1, fragment_readahead=1):
                yield from batch.to_pylist()


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller vec_id.

    Queries are rows whose vec_id is divisible by `every`; candidates are all rows of another vec_id and the
    query's dimension. Components count as floor(1024 * x). Rows with a null id, a null vector or a null or
    non-finite component take no part. Query rows that repeat are queries each, and so are candidates. Without
    usable queries or candidates the result is empty; an empty vector scores 0 with every other empty one.
    Scores beyond 64 bits are set to the nearest 64-bit value. Other columns aren't looked at."""
    spark = embeddings.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    source = source.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    # A bounded sample gives the pivots and first bounds of the queries.
    near = source.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample: dict = {}
    for part in near.to_batches():
        for d, (i, v) in _rows(part).items():
            old = sample.get(d)
            sample[d] = (i, v) if old is None else (np.concatenate([old[0], i]), np.concatenate([old[1], v]))
    folder = work_path(spark, "queries")
    asked = source.where(F.col("vec_id") % every == 0).mapInArrow(_queries(sample, k, BLOCK), "dim int, block string, ids binary, vectors binary, start binary")
    asked.write.parquet(folder)
    found = source.mapInArrow(_meet(sample, folder, k, HELD), "block string, n long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "n").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
