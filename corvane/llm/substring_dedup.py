"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the words of a text: each step shifts the hash by 32 bits and adds the word's
own gear value, so it depends on the last two words. A chunk ends where the hash is the smallest of SPAN neighbours:
an insertion moves the cuts near it and no others, no chunk is much longer than SPAN words, and two texts that share
a passage cut it alike between its first and its last cut. A passage is long if neighbouring chunks of it have
`least_words` words together: such runs of chunks, windows, are compared by 96-bit digests. Those that other
documents have as a whole are reported, joined where they overlap; `without_passages` leaves each in its first
document only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom, keep, mix, passing, small, word_hashes

WINDOW = 2
SPAN = 3
LEAST_WORDS = 16
FILTER_BITS = 1 << 24
_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse modulo 2**64, up to n - 1."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        _POWERS.clear()
        for base in _BASES:
            for b in (base, pow(base, -1, 2**64)):
                out = np.full(size, np.uint64(b), np.uint64)
                out[0] = 1
                _POWERS.append(np.cumprod(out, dtype=np.uint64))
    return [p[:n] for p in _POWERS]


def _cuts(hashes: np.ndarray) -> np.ndarray:
    """Where a hash is the smallest of SPAN neighbours in some place of them; of equal ones the last counts."""
    n = len(hashes)
    wins = np.ones(n, np.int32)  # itself, and the neighbours in a row that it beats on either side
    for side in (1, -1):
        beats = np.ones(n, bool)
        for j in range(1, SPAN):
            later, earlier = hashes[j:], hashes[:-j] if j < n else hashes[:0]
            if side == 1:
                beats[j:] &= later <= earlier
                beats[:j] = False
            else:
                beats[:-j] &= earlier < later
                beats[-j:] = False
            wins += beats
    return wins >= SPAN


def chunks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the chunks of a sequence of word hashes."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gear = mix(words ^ np.uint64(0x5851F42D4C957F2D))
    roll = gear.copy()
    for j in range(1, min(WINDOW, n)):
        roll[j:] += gear[:-j] << np.uint64(32 * j)
    ends = np.flatnonzero(_cuts(mix(roll[WINDOW - 1 :]))) + WINDOW
    first = np.r_[0, ends[ends < n]]
    return first, np.diff(np.r_[first, n])


def _digests(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits, independent of each other, by range of words."""
    out, powers = [], _powers(len(words))
    for power, inverse in zip(powers[::2], powers[1::2], strict=True):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power, out=total[1:])
        out.append(mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(first word, number of words, digests) of the shortest runs of chunks of `least` words or more from each
    chunk on, and of the one up to the text's end. No chunk is as long as that, so neighbours overlap."""
    first, n = chunks(words)
    last, c = first + n, len(first)
    if not c or last[-1] < least:
        none = first[:0]
        return none, none, none, none.astype(np.int32)
    stop = np.searchsorted(last, first + least, "left")
    start, stop = np.arange(c)[stop < c], stop[stop < c]
    tail = int(np.searchsorted(first, last[-1] - least, "right")) - 1
    if stop[-1] != c - 1 or start[-1] != tail:
        start, stop = np.r_[start, tail], np.r_[stop, c - 1]
    first, last = first[start], last[stop]
    return (first, last - first, *_digests(words, first, last))


def _windows_of(least: int):
    """Distinct windows by document, and how often each occurs in it."""

    def run(batches):
        for batch in small(batches):
            held: list[list] = [[], [], [], []]
            for i, t in enumerate(batch.column(1)):
                _, _, a, b = windows(word_hashes(t.as_py())[0], least)
                _, at, n = np.unique(a, return_index=True, return_counts=True)
                for x, v in zip(held, (np.full(len(at), i), a[at], b[at], n), strict=True):
                    x.append(v)
            row, a, b, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row.astype(np.int64))), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int32)), pa.array((n > 1).astype(bool))], ["doc_id", "a", "b", "twice"])

    return run


def _shared(least: int, table: np.ndarray):
    """The windows that the filter of shared digests lets through, with their places; `again`: not the document's first."""

    def run(batches):
        for batch in small(batches):
            held: list[list] = [[] for _ in range(6)]
            for i, t in enumerate(batch.column(1)):
                first, n, a, b = windows(word_hashes(t.as_py())[0], least)
                at = passing(a.view(np.uint64), table)
                again = np.ones(len(at), bool)
                again[np.unique(a[at], return_index=True)[1]] = False
                for x, v in zip(held, (np.full(len(at), i), first[at], n[at], a[at], b[at], again), strict=True):
                    x.append(v)
            row, first, n, a, b, again = (np.concatenate(x) if x else np.empty(0, np.int64) for x in held)
            row = pa.array(row.astype(np.int64))
            numbers = [pa.array(x.astype(k)) for x, k in ((first, np.int32), (n, np.int32), (a, np.int64), (b, np.int32), (again, bool))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), *numbers], ["doc_id", "tie", "first", "n", "a", "b", "again"])

    return run


def _runs(docs: DataFrame, least: int, within: bool) -> DataFrame:
    """doc_id, tie, first_word, end_word, owner_id, is_first: runs of overlapping windows, those that the document
    owns apart from the others."""
    if least < SPAN + WINDOW:
        raise ValueError(f"least_words must be {SPAN + WINDOW} or more")
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"))
    pairs = source.select("doc_id", "text").mapInArrow(_windows_of(least), "doc_id long, a long, b int, twice boolean")
    owners = pairs.groupBy("a", "b").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.bool_or("twice").alias("twice"))
    owners = keep(owners.where("owner <> last OR twice" if within else "owner <> last").select("a", "b", "owner"), "owners")
    rows = source.mapInArrow(_shared(least, bloom(owners, "a", FILTER_BITS)), "doc_id long, tie long, first int, n int, a long, b int, again boolean")
    rows = rows.join(owners, ["a", "b"]).dropDuplicates(["doc_id", "tie", "first", "n"])
    rows = rows.withColumn("is_first", (F.col("owner") == F.col("doc_id")) & ~(F.col("again") & F.lit(within)))
    order = Window.partitionBy("doc_id", "tie", "is_first").orderBy("first", "n")
    apart = F.coalesce(F.col("first") >= F.lag(F.col("first") + F.col("n")).over(order), F.lit(False))
    runs = rows.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order)).groupBy("doc_id", "tie", "is_first", "run")
    return runs.agg(F.min("first").cast("long").alias("first_word"), F.max(F.col("first") + F.col("n")).cast("long").alias("end_word"), F.min_by("owner", F.struct("first", "n")).alias("owner_id"))


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, within: bool = False) -> DataFrame:
    """One row per repeated passage of a document: doc_id, first_word, end_word, n_words, owner_id, is_first.

    A passage is a run of neighbouring chunks made of overlapping windows of `least_words` words or more, each
    of which documents of other ids have as a whole (with `within`, also the same document elsewhere): nothing shorter
    is reported. The run of a passage misses the up to SPAN words before its first cut and after its last, so every
    passage of least_words + 2 * SPAN words is found for certain, and a shorter one where its cuts lie well; to have all
    of n words ask for n - 2 * SPAN. owner_id is the smallest doc_id that has all of the run's first window; is_first
    tells that the document owns all its windows, so that the other copies can go and this one stay. A-Z count as a-z.
    Null, empty and short texts have no passages; rows that repeat an id with the same text count once; null ids take
    no part; an empty table gives an empty one; columns of other names aren't looked at. Windows can't be shorter than
    the longest chunk: fewer words are an error."""
    runs = _runs(docs, least_words, within)
    return runs.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "owner_id", "is_first")


def _without(text: str, runs: list[dict]) -> str:
    """The text without the words of the runs."""
    data = text.encode()
    _, starts, _ = word_hashes(data)
    gone = np.zeros(len(starts), bool)
    for r in runs:
        gone[r["first_word"] : r["end_word"]] = True
    bounds = np.r_[starts, len(data)]
    flips = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    at, out = 0, []
    for i, j in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
        out.append(data[at : int(bounds[i])])
        at = int(bounds[j])
    return b"".join([*out, data[at:]]).decode()


def _cut(batches):
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column(batch.schema.get_field_index("_text")), batch.column(batch.schema.get_field_index("_runs")), strict=True):
            value, found = text.as_py(), runs.as_py()
            texts.append(_without(value, found) if found and value else value)
        rest = [n for n in batch.schema.names if n not in ("_text", "_runs")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in rest), pa.array(texts, pa.string())], [*rest, "_text"])


def without_passages(docs: DataFrame, least_words: int = LEAST_WORDS, within: bool = False) -> DataFrame:
    """`docs` with each repeated passage left in the document that owns it only.

    Words of passages that another document owns are taken out of the text, with the white space after them. The
    owner has a smaller id, and where its own words go too a smaller one still has them, so no word goes from all
    documents. Every row stays, if with an empty text; null texts and ids stay as they are; rows that repeat an id
    with the same text are cut alike; an empty table gives an empty one; all columns are kept."""
    runs = _runs(docs, least_words, within).where("NOT is_first")
    runs = runs.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first_word", "end_word")).alias("_runs")).withColumnsRenamed({"doc_id": "_doc", "tie": "_tie"})
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("_text"))
    match = (F.col("_row.doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("_row.text") == F.col("_tie"))
    cut = row.join(runs, match, "left").select("_row", "_text", "_runs")
    kind = cut.select("_row", "_text").schema
    out = cut.mapInArrow(_cut, kind)
    return out.select(*(F.col("_text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
