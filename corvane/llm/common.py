"""Shared plumbing: table reading, the shared work folder, and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def _lean_memory() -> None:
    """Python workers live on between stages and beside the JVM, so what is freed must go back to the system: large
    blocks are mapped one by one, the heap is trimmed, and Arrow takes its buffers from there too."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library has its own ways
        pass


_lean_memory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is configured a local master gets a temporary one; a
    cluster's executors couldn't see that, so it is an error there."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corvane-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; `purge` removes all that this session made."""
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    _own().append((spark, path))
    return path


# The tables of each thread: queries that run side by side must not release each other's.
_made: list[list[tuple[SparkSession, str]]] = []
_thread = threading.local()


def _own() -> list[tuple[SparkSession, str]]:
    if not hasattr(_thread, "made"):
        _thread.made = []
        _made.append(_thread.made)
    return _thread.made


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a folder, for readers and writers in Python workers."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri).replace("s3a://", "s3://", 1))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """The number of this thread's tables so far, for `release`."""
    return len(_own())


def release(since: int) -> None:
    """Delete the tables that this thread made since a mark but the last one, when that one is all that is still read."""
    made = _own()
    while len(made) > since + 1:
        remove(*made.pop(since))


def purge() -> None:
    """Delete the intermediate tables of this process. Results that still read them become invalid."""
    for made in _made:
        while made:
            spark, path = made.pop()
            try:
                remove(spark, path)
            except Exception:  # noqa: BLE001  the session may have ended already
                return


atexit.register(purge)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back. It survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int):
    """crc32 of the value's decimal text, modulo n; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def small(batches, rows: int = 1024):
    """Arrow batches in slices of at most `rows` rows, so that a worker's memory doesn't follow the batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# --- Bloom filters ------------------------------------------------------------------------------
_SPREAD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def filter_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of `bits` bits, a power of two; a row a place."""
    down = np.uint64(64 - bits.bit_length() + 1)
    return np.stack([(hashes * np.uint64(s)) >> down for s in _SPREAD]).astype(np.int64)


def passing(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter, an array of 64-bit words, lets through."""
    at = np.arange(len(hashes))
    for s in _SPREAD:
        if not len(at):
            break
        row = ((hashes[at] * np.uint64(s)) >> np.uint64(58 - len(table).bit_length() + 1)).astype(np.int64)
        at = at[(table[row >> 6] >> (row & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
    return at


def _times(h, factor: int):
    """h * factor modulo 2**64, by 16-bit parts of h, since ANSI arithmetic refuses to overflow."""
    low, out = (1 << 32) - 1, None
    for i in range(4):
        part = F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF))
        f = (factor << (16 * i)) % 2**64
        lower, upper = part * F.lit(f & low), part * F.lit(f >> 32)  # both below 2**48
        out = (lower, upper) if out is None else (out[0] + lower, out[1] + upper)
    upper = (out[1] + F.shiftrightunsigned(out[0], 32)).bitwiseAND(F.lit(low))
    return F.shiftleft(upper, 32).bitwiseOR(out[0].bitwiseAND(F.lit(low)))


def bloom(df: DataFrame, column: str, most_bits: int, each: int = 32) -> np.ndarray:
    """A filter of the long column's values, about `each` bits a value and `most_bits` in all, a power of two: its
    words are made on the executors and come to the driver. A full one only lets more through."""
    bits = max(1 << 16, min(most_bits, 1 << (each * df.count()).bit_length()))
    places = F.array(*(F.shiftrightunsigned(_times(F.col(column), s), 64 - bits.bit_length() + 1) for s in _SPREAD))
    words = df.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return table


# --- word hashing -------------------------------------------------------------------------------
# A word's hash is sum(T[byte] * R**i) mod 2**64 over its bytes, got for all words of a text at once
# from prefix sums, then mixed. T and R come from a fixed seed, so every executor agrees.
_rng = np.random.default_rng(20240131)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)
_SEGMENT = 1 << 18
_POWERS: list[np.ndarray] = []
STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_R, _RINV):
            out = np.ones(_SEGMENT + 1, np.uint64)
            done = 1
            while done < len(out):
                more = min(done, len(out) - done)
                out[done : done + more] = out[:more] * np.uint64(pow(base, done, 2**64))
                done += more
            _POWERS.append(out)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes | None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes and byte bounds of the words of UTF-8 text, in order. Words are runs of bytes other
    than space and \\t..\\r; with `lower`, A-Z count as a-z. Memory is bounded by a segment, not the text."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if lower:
        text = text.translate(_LOWER)
    power, inverse = _powers()
    whole = np.frombuffer(text, np.uint8)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(whole):
        stop = min(at + _SEGMENT, len(whole))
        if stop < len(whole):  # end the segment at a space, unless a word is longer than that
            gaps = np.flatnonzero(_SPACE[whole[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[whole[stop:]])
                stop = stop + int(rest[0]) if len(rest) else len(whole)
                hashes.append(np.array([hash_bytes(text[at:stop])], np.uint64))
                starts.append(np.array([at]))
                ends.append(np.array([stop]))
                at = stop
                continue
        b = whole[at:stop]
        gap = np.ones(len(b) + 2, np.int8)
        gap[1:-1] = _SPACE[b]
        edge = np.diff(gap)
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        prefix = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * power[: len(b)], out=prefix[1:])
        hashes.append(mix((prefix[e] - prefix[s]) * inverse[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def hash_bytes(word: bytes) -> int:
    """The same hash for one word of any length."""
    total, scale, power = 0, 1, _powers()[0]
    for at in range(0, len(word), _SEGMENT):
        b = np.frombuffer(word[at : at + _SEGMENT], np.uint8)
        with np.errstate(over="ignore"):
            part = int(np.sum(_TABLE[b] * power[: len(b)], dtype=np.uint64))
        total = (total + part * scale) % 2**64
        scale = scale * pow(_R, len(b), 2**64) % 2**64
    return int(mix(np.array([total], np.uint64))[0])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter, non-empty sequence is one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        out = out + words[j : n - width + 1 + j] * STEP[j]
    return np.unique(mix(out))
