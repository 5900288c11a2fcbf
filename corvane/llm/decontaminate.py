"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of a window's words and ignore the others, so a mask that skips a substituted word
still matches. The hashes of the selected words of every window of every document are tested against a Bloom
filter of the benchmark's; the few that pass are joined with the benchmark's hashes. Around each hit, document
and item are laid over each other, and of all runs of words with at least 80 % matches the one of the most
matches counts: a match scores 1, a difference -4, and a run has 80 % if its sum isn't negative.

Four masks of five words meet every such run of 15 words or more. For items of 5, 6, 10 or 11 words, where
differences can leave less than a mask needs, masks of four words are looked up as well. Shorter items, which
a long text holds by chance, are compared whole.

A phrase that many items share would join each of its documents with each of these items. Under all eight masks the
windows that meet cover at least nine matching words of any run that counts for an item of 15 words or more. So where
windows that more than COMMON_ITEMS items have cover less than that in any WINDOW words of an item, some other window
of it meets as well, and the common ones aren't looked up for this item.

Places of equal hashes travel as lists, a list a document and one an item, never as pairs. Where these lists
stand for more pairs than there are ways to lay the two texts over each other, all of these ways are tried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP, bloom, keep, mark, mix, passing, release, small, word_hashes

MASKS = ("11111", "1111011", "1101111", "1110111")
SHORT_MASKS = ("1111", "11101", "11011", "10111")
SHORT_ITEMS = (5, 6, 10, 11)
LEAST_WORDS = 5
COMMON_ITEMS = 8
COVERED = 9  # matching words that windows cover at least, in a run of 12 to 23 matches under all masks
WINDOW = 28  # words of a run of 23 matches; every longer run that counts holds one of 12 to 23 matches that does
MISMATCH = -4
MIN_WORDS = 12
FILTER_BITS = 1 << 28
BROADCAST_WORDS = 1_000_000
CELLS = 1 << 22


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, np.uint64(int(mask, 2)), np.uint64)
    for j, used in enumerate(mask):
        if used == "1":
            out = out + words[j : j + n] * STEP[j]
    return mix(out)


def whole(words: np.ndarray) -> np.ndarray:
    """One hash of a text of less than five words."""
    return mix((words * STEP[: len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(1024 + len(words)))


def placed(words: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text under the masks, or of the whole of a short one."""
    if 0 < len(words) < LEAST_WORDS:
        return whole(words), np.zeros(1, np.int64)
    found = [seeds(words, m) for m in masks]
    return np.concatenate([words[:0], *found]), np.concatenate([np.empty(0, np.int64), *(np.arange(len(f)) for f in found)])


def _lists(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct hashes and the list of places of each."""
    order = np.argsort(hashes, kind="stable")
    values, first = np.unique(hashes[order], return_index=True)
    return values.view(np.int64), pa.ListArray.from_arrays(pa.array(np.r_[first, len(hashes)], pa.int32()), pa.array(places[order], pa.int32()))


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, end) of the run of the most matches among the runs with at least 80 % matches."""
    hits = np.r_[0, np.cumsum(same)]
    score = np.r_[0, np.cumsum(np.where(same, 1, MISMATCH))]
    # For each end the earliest start whose score isn't higher: longer runs hold no fewer matches.
    start = np.searchsorted(-np.minimum.accumulate(score), -score, "left")
    end = int(np.argmax(hits - hits[start]))
    inside = np.flatnonzero(same[start[end] : end]) + start[end]
    return (len(inside), int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0, 0)


def shifts(n: int, m: int, lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Ways to lay an item of m words over a document of n, from places of equal hashes: all ways, if the places
    stand for more pairs than there are."""
    if sum(len(p) * len(q) for p, q in lists) > n + m:
        return np.arange(1 - m, n)
    return np.unique(np.concatenate([(p[:, None] - q[None, :]).ravel() for p, q in lists])) if lists else np.empty(0, np.int64)


def overlap(words: np.ndarray, item: np.ndarray, ways: np.ndarray) -> tuple[int, int, int] | None:
    """(matching words, first word, end word) of the best run over all ways, the earliest of equals; None if it
    is below what the item asks for."""
    m = len(item)
    need = min(MIN_WORDS, -(-4 * m // 5))
    if m < LEAST_WORDS:
        return (m, 0, m) if np.array_equal(words, item) else None
    other = next(np.uint64(x) for x in range(m + 1) if not (item == x).any())  # in no item: beyond the ends nothing matches
    edge = np.full(m - 1, other, np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, words, edge]), m)
    step = max(1, CELLS // m)
    totals = np.concatenate([np.empty(0, np.int64), *((views[ways[at : at + step] + m - 1] == item).sum(1) for at in range(0, len(ways), step))])
    best = None
    for i in np.lexsort((ways, -totals)).tolist():  # a run has no more matches than its whole way
        if totals[i] < need or best and totals[i] <= best[0]:
            break
        way = int(ways[i])
        matched, start, end = best_run(views[way + m - 1] == item)
        if matched >= need and (not best or matched > best[0]):
            best = (matched, way + start, way + end)
    return best


def _hashed(lists: bool):
    """Benchmark rows (iid, item_id, text) as words, or as hashes with their places."""

    def run(batches):
        for batch in batches:
            for iid, item, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = word_hashes(text.as_py())[0]
                if not lists:
                    values = pa.array([words.view(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([iid.as_py()]), pa.array([item.as_py()], pa.int64()), values, pa.array([len(words)], pa.int64())], ["iid", "item_id", "item", "n"])
                    continue
                masks = MASKS + SHORT_MASKS if len(words) in SHORT_ITEMS else MASKS
                hashes, places = _lists(*placed(words, masks))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([iid.as_py()] * len(hashes), pa.int64()), places], ["hash", "iid", "places"])

    return run


def _fine(batches):
    """Benchmark rows as hashes under all masks, with places and the words of the item that the windows use."""
    for batch in batches:
        for iid, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            words = word_hashes(text.as_py())[0]
            for mask in MASKS + SHORT_MASKS:
                hashes = seeds(words, mask)
                values, places = _lists(hashes, np.arange(len(hashes)))
                used = np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1"))
                covered = pa.array([np.unique(p.values.to_numpy(zero_copy_only=False)[:, None] + used) for p in places], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([iid] * len(values), pa.int64()), places, covered], ["hash", "iid", "places", "covered"])


def _without_common(index: DataFrame, items: DataFrame, known: DataFrame) -> tuple[DataFrame, bool]:
    """The index, where common windows go that aren't needed, and whether it now needs all masks."""
    common = lambda df: df.groupBy("hash").count().where(F.col("count") > COMMON_ITEMS).select("hash")
    crowded = index.join(common(index), "hash", "left_semi").select("iid").distinct().join(known.where(f"n >= {MIN_WORDS + 3}").select("iid"), "iid", "left_semi")
    crowded = keep(crowded, "crowded")
    if crowded.isEmpty():
        return index, False
    fine = keep(items.join(crowded, "iid", "left_semi").select("iid", "item_id", "text").mapInArrow(_fine, "hash long, iid long, places array<int>, covered array<int>"), "fine_seeds")
    hot = keep(common(fine), "common")
    places = fine.join(hot, "hash", "left_semi").select("iid", F.explode("covered").alias("at")).distinct()
    ahead = Window.partitionBy("iid").orderBy("at").rangeBetween(0, WINDOW - 1)
    dense = places.withColumn("n", F.count("*").over(ahead)).groupBy("iid").agg(F.max("n").alias("n")).where(F.col("n") >= COVERED)
    rows = fine.drop("covered").join(hot.withColumn("_hot", F.lit(True)), "hash", "left").join(dense.select("iid", F.lit(True).alias("_dense")), "iid", "left")
    rows = rows.where("_hot IS NULL OR _dense").select("hash", "iid", "places")
    return keep(index.join(crowded, "iid", "left_anti").select("hash", "iid", "places").unionByName(rows), "seeds"), True


def _scanned(table: np.ndarray, masks: tuple[str, ...]):
    """Documents (rid, doc_id, tie, text) with a window that the filter lets through: their words, and these hashes with places."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("positions", pa.list_(pa.int32()))]))

    def run(batches):
        for batch in small(batches):
            rows, words_of, hits = [], [], []
            for i, text in enumerate(batch.column(3)):
                words = word_hashes(text.as_py())[0]
                hashes, places = placed(words, masks)
                at = passing(hashes, table)
                if len(at):
                    values, lists = _lists(hashes[at], places[at])
                    rows.append(i)
                    words_of.append(words.view(np.int64))
                    hits.append(pa.StructArray.from_arrays([pa.array(values), lists], ["hash", "positions"]))
            if rows:
                ends = np.r_[0, np.cumsum([len(h) for h in hits])]
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(hits)).cast(kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in range(3)), pa.array(words_of, pa.list_(pa.int64())), found], ["rid", "doc_id", "tie", "words", "hits"])

    return run


def _verified(batches):
    numbers = lambda x: x.values.to_numpy(zero_copy_only=False)
    for batch in batches:
        rows = []
        for doc, tie, words, item_id, item, places in zip(*(batch.column(i) for i in range(6)), strict=True):
            words, item = numbers(words).view(np.uint64), numbers(item).view(np.uint64)
            pairs = places.values
            lists = [(p, q) for p, q in zip(map(_int64, pairs.field("positions")), map(_int64, pairs.field("places")), strict=True)]
            best = overlap(words, item, shifts(len(words), len(item), lists))
            if best:
                rows.append((doc.as_py(), tie.as_py(), item_id.as_py(), best[1], best[2], best[0]))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.binary(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "tie", "item_id", "first_word", "end_word", "matching_words"])


def _int64(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).astype(np.int64)


_SCHEMA = "doc_id long, tie binary, item_id long, first_word long, end_word long, matching_words long"


def _found(docs: DataFrame, benchmark: DataFrame, tie) -> DataFrame:
    """One row per document row and benchmark row that overlap, with the document's `tie`."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    items = keep(items.withColumn("iid", F.monotonically_increasing_id()), "items").select("iid", "item_id", "text")
    known = keep(items.mapInArrow(_hashed(False), "iid long, item_id long, item array<long>, n long"), "item_words").where("n > 0")
    total, short = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_or(F.col("n").isin(*SHORT_ITEMS)), F.lit(False))).first()
    if not total:
        return spark.createDataFrame([], _SCHEMA)
    index = keep(items.mapInArrow(_hashed(True), "hash long, iid long, places array<int>"), "seeds")
    index, fine = _without_common(index, items, known)
    short = short or fine
    table = bloom(index, "hash", FILTER_BITS, 128)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), F.col("text").cast("binary").alias("text"))
    source = source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "tie", "text")
    scanned = source.mapInArrow(_scanned(table, MASKS + SHORT_MASKS if short else MASKS), "rid long, doc_id long, tie binary, words array<long>, hits array<struct<hash:long,positions:array<int>>>")
    scanned = keep(scanned, "hits")
    met = scanned.select("rid", F.explode("hits").alias("h")).select("rid", "h.hash", "h.positions").join(index, "hash")
    met = met.groupBy("rid", "iid").agg(F.collect_list(F.struct("positions", "places")).alias("at"))
    met = met.join(F.broadcast(known) if total <= BROADCAST_WORDS else known, "iid").join(scanned.select("rid", "doc_id", "tie", "words"), "rid")
    return met.select("doc_id", "tie", "words", "item_id", "item", "at").mapInArrow(_verified, _SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, first_word, end_word (of the
    document), matching_words.

    They overlap if a run of aligned words has at least 80 % matches and 12 of them (for items of less than
    15 words, 80 % of the item). Items of less than five words overlap with documents of just these words. A-Z
    count as a-z. Null, empty and word-less texts and items overlap with nothing; repeated documents and items are
    listed each, with null ids as null; columns of other names aren't looked at; an empty table gives an empty
    one. Only hits are shuffled, and the words of documents that have some."""
    return _found(docs, benchmark, F.lit(b"")).drop("tie")


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that overlap with a benchmark item, found as in `contamination`.

    It's the text that decides, so of rows that repeat an id only those go whose text overlaps, and null ids need
    no care. Null and empty texts stay; an empty benchmark leaves all rows and an empty table gives an empty one."""
    tie = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    since = mark()
    bad = keep(_found(docs, benchmark, tie).select(F.col("tie").alias("_tie")).distinct(), "overlapping")
    release(since)
    return docs.join(bad, tie == F.col("_tie"), "left_anti")
