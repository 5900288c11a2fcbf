"""Exact duplicates by Grace hashing: records are dealt to buckets, and a bucket is settled by an open-addressing table.

Nothing but the complete content decides whether two texts are equal; hashes only say where to look. Three things
bound a task's memory, whatever the data:

- A table holds `table_bytes` of different contents at most. What a full table doesn't know is written out as a
  spilled record and dealt anew, to other buckets, in the next round. Records of a content that the table does know
  are always absorbed, so a content is settled in one round or goes on as a whole.
- Every task merges its own copies before anything is shuffled: one record a content and table leaves the scan.
- Contents that still come from very many tasks are merged in parts first (`MANY`), and their parts in the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import bloom, keep, passing, small

TABLE_BYTES = 32 << 20
OVERHEAD = 100  # of an entry besides its content
MANY = 1024  # records of one content hash that may meet in one bucket
MOST_BITS = 1 << 25

_FIRST = "doc_id long, key long, first long, sha binary, h long, n long, top long, top_key long, bytes long, text binary"
_ROUND = "kind int, key long, to long, h long, n long, top long, top_key long, bytes long, text binary"
CLASS, LINK, SPILLED = 0, 1, 2


class ContentTable:
    """An open-addressing table from complete contents to entries, with linear probing."""

    def __init__(self, most_bytes: int):
        self.most_bytes, self.bytes = most_bytes, 0
        self.slots, self.hashes, self.contents = np.full(64, -1, np.int64), [], []

    def _place(self, h: int) -> int:
        return (h * 0x9E3779B97F4A7C15 >> 20) & (len(self.slots) - 1)

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """The content's entry, or -1 and the free slot where it would go."""
        at, wrap = self._place(h), len(self.slots) - 1
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, at
            at = (at + 1) & wrap
        return -1, at

    def full(self, content: bytes) -> bool:
        """Whether a new content is too much; the first one never is."""
        return bool(self.contents) and self.bytes + len(content) + OVERHEAD > self.most_bytes

    def add(self, h: int, content: bytes, slot: int) -> int:
        entry = len(self.contents)
        self.slots[slot] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + OVERHEAD
        if 2 * len(self.contents) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            wrap = len(self.slots) - 1
            for e, g in enumerate(self.hashes):
                at = self._place(g)
                while self.slots[at] >= 0:
                    at = (at + 1) & wrap
                self.slots[at] = e
        return entry


def content_hash(content: bytes) -> int:
    """Signed, as a long column holds it."""
    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


def _larger(id_a, key_a, id_b, key_b) -> bool:
    """Whether row b stays rather than row a: the larger id, null the smallest; of equal ids the smaller key."""
    if id_a is None or id_b is None:
        return (id_b is not None) or (id_a is None and key_b < key_a)
    return (id_b, -key_b) > (id_a, -key_a)


def _scan(table_bytes: int):
    """Rows get a key, their digest and the key of the first copy in their table; the first one, once the table is
    full or the task ends, carries the content and what was merged into it."""

    def flushed(table, firsts):
        for (key, doc_id, sha, n, top, top_key), h, content in zip(firsts, table.hashes, table.contents, strict=True):
            yield doc_id, key, key, sha, h, n, top, top_key, len(content), content

    def rows(batches):
        key = TaskContext.get().partitionId() << 36
        table, firsts = ContentTable(table_bytes), []
        for batch in small(batches):
            contents = batch.column(1).cast(pa.binary())
            for doc_id, content in zip(batch.column(0).to_pylist(), contents, strict=True):
                content = content.as_py() or b""
                h = content_hash(content)
                entry, slot = table.find(h, content)
                if entry < 0:
                    if table.full(content):
                        yield from flushed(table, firsts)
                        table, firsts = ContentTable(table_bytes), []
                        _, slot = table.find(h, content)
                    table.add(h, content, slot)
                    firsts.append([key, doc_id, hashlib.sha256(content).digest(), 1, doc_id, key])
                else:
                    first = firsts[entry]
                    first[3] += 1
                    if _larger(first[4], first[5], doc_id, key):
                        first[4], first[5] = doc_id, key
                    yield doc_id, key, first[0], first[2], None, None, None, None, None, None
                key += 1
        yield from flushed(table, firsts)

    return lambda batches: _batches(rows(batches), _FIRST)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batches(rows, schema: str, most: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [_TYPES[c.split()[1]] for c in schema.split(", ")]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= most or size >= most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _settle(table_bytes: int):
    """One bucket: its records are absorbed by the table or spilled. Buckets of parts (part >= 0) pass each content on
    as one merged record; in others every absorbed record learns its class."""

    def rows(batches):
        table, totals, absorbed, merge = ContentTable(table_bytes), [], [], False
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("key", "h", "n", "top", "top_key", "part")}
            for i, content in enumerate(batch.column("text")):
                content, h = content.as_py(), c["h"][i]
                merge = c["part"][i] >= 0
                entry, slot = table.find(h, content)
                if entry < 0 and table.full(content):
                    yield SPILLED, c["key"][i], None, h, c["n"][i], c["top"][i], c["top_key"][i], len(content), content
                    continue
                if entry < 0:
                    entry = table.add(h, content, slot)
                    totals.append([c["key"][i], c["n"][i], c["top"][i], c["top_key"][i]])
                else:
                    t = totals[entry]
                    t[1] += c["n"][i]
                    if _larger(t[2], t[3], c["top"][i], c["top_key"][i]):
                        t[2], t[3] = c["top"][i], c["top_key"][i]
                absorbed.append((c["key"][i], entry))
        if merge:
            for (key, n, top, top_key), h, content in zip(totals, table.hashes, table.contents, strict=True):
                yield SPILLED, key, None, h, n, top, top_key, len(content), content
        for key, entry in absorbed:
            first, n, top, top_key = totals[entry]
            if not merge:
                yield CLASS, key, None, None, n, top, top_key, None, None
            elif key != first:
                yield LINK, key, first, None, None, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), _ROUND)

    return run


def _dealt(records: DataFrame, level: int, table_bytes: int, many: int) -> DataFrame:
    """Adds bucket and part. A bucket takes half a table of bytes on average; every round deals by another hash.
    Records whose hash occurs more than `many` times go to parts; the filter that knows these hashes is of bounded
    size and may take more of them, which costs these another round only."""
    spark = records.sparkSession
    size = records.agg(F.coalesce(F.sum(F.col("bytes") + OVERHEAD), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // table_bytes))
    part = F.lit(-1)
    # Every second round only, so that there is always a next one in which contents are settled.
    hot = records.groupBy("h").count().where((F.col("count") > many) & F.lit(level % 2 == 0)).select("h")
    if not hot.isEmpty():
        table = bloom(hot, "h", MOST_BITS)

        def mark(batches):
            for batch in batches:
                h = np.asarray(batch.column("h")).view(np.uint64)
                found = np.zeros(len(h), bool)
                found[passing(h, table)] = True
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "hot"])

        records = records.mapInArrow(mark, StructType([*records.schema.fields, StructField("hot", BooleanType())]))
        part = F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(level), "key"), F.lit(max(1, many // 16)))).otherwise(-1)
    # Parts are buckets too, so that a bucket holds nothing but one part's records or none of any.
    rows = records.withColumn("part", part.cast("int"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "h", "part"), F.lit(buckets)))


def membership(docs: DataFrame, table_bytes: int = TABLE_BYTES, many: int = MANY) -> DataFrame:
    """doc_id, text of any rows -> a row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical, null counting as empty. Of equal texts the row with the largest doc_id
    stays: keep_id is its id, `kept` marks that row alone, and where that id repeats with the same text, one of its
    rows. A null id is smaller than every other; a group of null ids has a null keep_id, and one of its rows stays.
    Other columns play no part, whatever their names. An empty table gives an empty result.
    """
    rows = keep(docs.select("doc_id", "text").mapInArrow(_scan(table_bytes), _FIRST), "records")
    records = rows.where("h IS NOT NULL").select("key", "h", "n", "top", "top_key", "bytes", "text")
    rounds, level = [], 0
    while True:
        dealt = _dealt(records, level, table_bytes, many)
        done = keep(dealt.groupBy("bucket", "part").applyInArrow(_settle(table_bytes), _ROUND), "round")
        rounds.append(done)
        records = done.where(f"kind = {SPILLED}").drop("kind", "to")
        if records.isEmpty():
            break
        level += 1
    # Links lead from a merged record to the one that went on, round by round, so classes are known from the last.
    found = lambda df: df.where(f"kind = {CLASS}").select("key", "n", "top", "top_key")
    classes = reduce(lambda later, df: found(df).unionByName(later).unionByName(df.where(f"kind = {LINK}").select("key", F.col("to").alias("_to")).join(later.withColumnRenamed("key", "_to"), "_to").drop("_to")), reversed(rounds[:-1]), found(rounds[-1]))
    of_row = rows.select("doc_id", F.col("key").alias("_row"), F.col("first").alias("key"), "sha")
    return of_row.join(classes, "key").select(
        "doc_id",
        F.col("top").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("_row") == F.col("top_key")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs without the rows that `membership` drops, all columns kept. Where an id repeats with the same text, one
    of its rows stays."""
    kept = membership(docs, table_bytes).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.withColumn("_sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = rows.join(kept.withColumnRenamed("_sha", "_digest"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest")))
    return rows.withColumn("_null", F.col("doc_id").isNull()).dropDuplicates(["_null", "_id", "_sha"]).drop("_null", "_id", "_sha", "_digest")
