"""Token-id files: frequency-ranked ids in byte-aligned variable-length codes with separate control bytes.

Ids are replaced by their rank of corpus frequency, so that common tokens take one byte. A value takes
1 to 4 bytes; its length minus one is a 2-bit code, and four codes share a control byte. Control and data
bytes are kept apart, so a reader finds all lengths by one table lookup and gathers all values at once.

A shard file holds frames; a frame holds whole documents:
  b"RVB2" | u32 documents | u64 control bytes | u64 data bytes | u8 by document, 1: its doc id is null
  | i64 doc ids | u64 ids by document | control bytes, each document's padded to a byte | data bytes
Beside the shards, `ranks.bin` holds the id of each rank as u32. Integers are little-endian. Shards are in
ascending order of doc_id, and so are the documents of a shard; or both follow the order of the input's files.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, keep, remove, small, work_path

END_ID = 1
CACHED = 300_000
PART = 1 << 23
FRAME_IDS = 1 << 20
SHARD_IDS = 1 << 22
MOST_SHARDS = 10_000  # beyond, shards grow; a shard is streamed, so its size takes no memory
SHARD_ROWS = 1 << 16
_HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("control", "<u8"), ("data", "<u8")])


class Memory(dict):
    """Results of a function by text, bounded. A text is kept once it comes a second time while it is on probation, so
    that what comes once doesn't fill the memory; a full one, and a full probation, is forgotten as a whole."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.probation = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.probation.pop(key, None)
        if found is None:
            found = self.make(key)
            if len(self.probation) >= self.most:
                self.probation.clear()
            self.probation[key] = found
            return found
        if len(self) >= self.most:
            self.clear()
            self[""] = b""
        self[key] = found
        return found


# --- tokenizer ----------------------------------------------------------------------------------
class Encoder:
    """A tokenizers-library tokenizer with a bounded memory of the units it has met.

    Where the tokenizer is known to lower-case and to cut texts by UNITS before its model runs, texts of plain
    characters are cut here and each new unit goes to the library's model once; all other texts, and all texts
    under other tokenizers, go through the library's whole pipeline."""

    #: The normalizer and pattern of the tokenizer that this holds for.
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    #: Of these characters NFC changes none, and Python's lower() does what the library does.
    PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
    #: What the pattern takes apart from letters, for lower-case plain characters.
    MARKS = "'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\\[-`{-~]+"

    def __init__(self, path: str, cached: int = CACHED, part: int | None = None):
        self.part = part  # characters that go through at once, PART by default
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.dtype, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.units = Memory(self._unit, cached)
        self.units[""] = b""
        # Bytes that print stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in shown]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        kinds = (parts["normalizer"] or {}).get("normalizers", [])
        cuts = [c.get("pattern", {}).get("Regex") for c in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.direct = kinds == self.NORMALIZERS and cuts == [self.PATTERN, None] and sys.byteorder == "little"
        if self.direct:  # and only if a probe agrees
            probe = "Ab\u00c9c. d!?'s \u00fcber--x 12 it's |*** e<b>"
            self.direct = self.encode(probe) == self._full(probe)

    def _full(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        shown = unit if unit.isascii() else "".join([self.byte_chars[b] for b in unit.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian integers of `dtype`."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Plain ones go through in groups of PART characters; a longer one is cut at blanks,
        where no unit goes on."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, whose, size, most = [], [], 0, self.part or PART

        def flush():
            for i, ids in zip(whose, self._units_of(group), strict=True):
                out[i].append(ids)
            group.clear()
            whose.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.direct or not self._plain(text):
                out[i].append(self._full(text))
                continue
            at = 0
            while at < len(text):
                stop = _space(text, at + most)
                group.append(text[at:stop])
                whose.append(i)
                size += stop - at
                at = stop
                if size >= most:
                    flush()
                    size = 0
        if group:
            flush()
        return [b"".join(x) for x in out]

    def _units_of(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: blanks are put around what isn't letters, so that units are what blanks part; each
        different unit is looked up once."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), pattern=self.MARKS, replacement=r" \0 ")
        parts = pc.ascii_split_whitespace(spaced)
        found = parts.flatten().dictionary_encode()
        pieces = list(map(self.units.__getitem__, found.dictionary.to_pylist()))
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // width
        starts, index = np.cumsum(sizes) - sizes, found.indices.to_numpy()
        counts = sizes[index]
        ends = np.cumsum(counts)
        data = np.frombuffer(b"".join(pieces), self.dtype)
        ids = data[np.repeat(starts[index] - ends + counts, counts) + np.arange(int(counts.sum()))].tobytes()
        cuts = (np.r_[0, ends][parts.offsets.to_numpy()] * width).tolist()
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, self.PLAIN) and not any(t in text for t in self.added)
        except UnicodeEncodeError:
            return False


def _space(text: str, at: int) -> int:
    """The place of the first blank from `at` on."""
    found = text.find(" ", at)
    return len(text) if found < 0 else found


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, cached: int = CACHED, part: int | None = None) -> Encoder:
    if (path, cached, part) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, cached, part] = Encoder(path, cached, part)
    return _ENCODERS[path, cached, part]


# --- codes --------------------------------------------------------------------------------------
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def _slots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length codes by document, a multiple of four, and which of them all belong to a value."""
    room = -(-counts // 4) * 4
    pads = room - counts
    used = np.ones(int(room.sum()), bool)
    used[np.repeat(np.cumsum(room) - np.cumsum(pads), pads) + np.arange(int(pads.sum()))] = False
    return room, used


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(control bytes, data bytes) by document of u32 values that follow each other, `counts` each."""
    v = np.ascontiguousarray(values, "<u4")
    codes = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    room, used = _slots(counts)
    four = np.zeros(len(used), np.uint8)
    four[used] = codes
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8)[None, :] <= codes[:, None]].tobytes()
    size = np.r_[0, np.cumsum(codes.astype(np.int64) + 1)]
    ends = np.cumsum(counts)
    at, cut = size[ends - counts].tolist(), size[ends].tolist()
    c_end = np.cumsum(room // 4)
    c_at = c_end - room // 4
    return [control[i:j] for i, j in zip(c_at.tolist(), c_end.tolist(), strict=True)], [data[i:j] for i, j in zip(at, cut, strict=True)]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of documents whose control bytes follow each other, `counts` values each."""
    lengths = _LENGTHS[control].ravel()[_slots(counts)[1]]
    at = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = lengths > k
        if not more.any():
            break
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def frame(ids: list[int | None], counts: list[int], controls: list[bytes], datas: list[bytes]) -> bytes:
    control, data = b"".join(controls), b"".join(datas)
    head = np.array([(b"RVB2", len(ids), len(control), len(data))], _HEAD)
    null = bytes(i is None for i in ids)
    return head.tobytes() + null + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array(counts, "<u8").tobytes() + control + data


def frames(stream) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, counts, values) of each frame of an open shard."""
    while head := stream.read(_HEAD.itemsize):
        h = np.frombuffer(head, _HEAD)[0]
        if bytes(h["magic"]) != b"RVB2":
            raise ValueError("not a token shard")
        n = int(h["docs"])
        null = np.frombuffer(stream.read(n), np.uint8) == 1
        ids, counts = np.frombuffer(stream.read(8 * n), "<i8"), np.frombuffer(stream.read(8 * n), "<u8").astype(np.int64)
        control, data = np.frombuffer(stream.read(int(h["control"])), np.uint8), np.frombuffer(stream.read(int(h["data"])), np.uint8)
        yield pa.array(ids, pa.int64(), mask=null), counts, unpack(control, data, counts)


# --- jobs ---------------------------------------------------------------------------------------
def _tokenize(tokenizer: str, cached: int, part: int | None = None):
    """Ids of documents; a last row of each task has no document, but how often each id came."""

    def run(batches):
        enc = encoder(tokenizer, cached, part)
        end = np.array([END_ID], enc.dtype).tobytes()
        total, rest = np.zeros(enc.size, np.int64), None
        for batch in small(batches, 4096 if part is None else max(64, part // 2048)):
            ids = [x + end for x in enc.encode_all(batch.column(1).to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(ids), enc.dtype), minlength=enc.size)
            rest = batch.schema.names[2:], [c.type for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary()), *batch.columns[2:]], ["doc_id", "ids", "counts", *rest[0]])
        if rest:
            counts = pa.array([total.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), counts, *(pa.nulls(1, t) for t in rest[1])], ["doc_id", "ids", "counts", *rest[0]])

    return run


def _count(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in small(batches, 64):
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return run


def _code(dtype: str, rank_of: np.ndarray, cuts: np.ndarray | None):
    """Coded documents with their shard, by `cuts` between doc ids, or as the input has it."""

    def run(batches):
        width = np.dtype(dtype).itemsize
        for batch in small(batches):
            raw = batch.column(1).to_pylist()
            counts = np.array([len(x) // width for x in raw], np.int64)
            controls, datas = pack(rank_of[np.frombuffer(b"".join(raw), dtype)], counts)
            if cuts is None:
                part, tie = batch.column(2), batch.column(3)
            else:
                part = pa.array([0 if d is None else int(np.searchsorted(cuts, d, "left")) for d in batch.column(0).to_pylist()], pa.int32())
                tie = pa.array([zlib.crc32(x) for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), tie, pa.array(controls, pa.binary()), pa.array(datas, pa.binary()), part], ["doc_id", "n", "tie", "control", "data", "part"])

    return run


def _write(folder: str):
    def run(batches):
        fs, base = filesystem(folder)
        shard = TaskContext.get().partitionId()
        name = f"{base}/shard-{shard:06d}.tok"
        scratch = f"{base}/.{uuid.uuid4().hex}.part"  # renamed when whole, so a lost task leaves no shard
        docs = total = 0
        stream = None
        held: list[list] = [[], [], [], []]

        def flush():
            if held[0]:
                stream.write(frame(*held))
                for x in held:
                    x.clear()

        for batch in small(batches):
            stream = stream or fs.open_output_stream(scratch)
            for doc, n, control, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                for x, v in zip(held, (doc, n, control, data), strict=True):
                    x.append(v)
                docs, total = docs + 1, total + n
                if sum(held[1]) >= FRAME_IDS:
                    flush()
        if stream:
            flush()
            stream.close()
            fs.move(scratch, name)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["shard", "docs", "ids"])

    return run


def _places(docs: DataFrame) -> DataFrame | None:
    """`docs` with the file and row that each of its rows is read from; None if it isn't read from files."""
    try:
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("tie"))
    except AnalysisException:
        return None


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, cached: int = CACHED, as_read: bool = False, part: int | None = None) -> DataFrame:
    """Write the documents' ids below `folder`; returns the manifest: shard, docs, ids (one row a shard).

    docs: doc_id, text; other columns aren't looked at. A null text has the end id only; null doc_ids come first.
    Rows that repeat a doc_id follow each other in an order that depends on their ids alone. With `as_read`, and if
    `docs` is a table of files, documents keep the order of the files by name and of their rows instead. An empty
    table gives no shard. `tokenizer` must exist on every worker."""
    spark = docs.sparkSession
    enc = encoder(tokenizer, cached, part)
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    raw_path = work_path(spark, "ids")
    placed = _places(docs) if as_read else None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, ids binary, counts binary"
    if placed is not None:
        source, schema = placed.withColumn("doc_id", F.col("doc_id").cast("long")), schema + ", file string, tie long"
    raw = source.mapInArrow(_tokenize(tokenizer, cached, part), schema)
    raw.write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema(raw.schema).parquet(raw_path)
    # One row per id of the vocabulary at most comes to the driver.
    counts = raw.select("counts").where("counts IS NOT NULL").mapInArrow(_count(enc.size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(enc.size, np.int64)
    for r in counts:
        total[r.id] = r.n
    by_rank = np.lexsort((np.arange(enc.size), -total)).astype("<u4")
    rank_of = np.empty(enc.size, np.uint32)
    rank_of[by_rank] = np.arange(enc.size, dtype=np.uint32)
    with fs.open_output_stream(f"{base}/ranks.bin") as out:
        out.write(by_rank.tobytes())
    raw = raw.where("ids IS NOT NULL").drop("counts")
    if placed is not None:  # a shard per file, or per SHARD_ROWS rows of one
        raw = raw.withColumn("range", F.shiftright("tie", SHARD_ROWS.bit_length() - 1))
        parts = sorted(raw.select("file", "range").distinct().collect())  # a small row a shard
        known = spark.createDataFrame([(f, r, i) for i, (f, r) in enumerate(parts)], "file string, range long, part int")
        raw = raw.join(F.broadcast(known) if len(parts) <= MOST_SHARDS else known, ["file", "range"])
        raw, cuts, n_parts, order = raw.select("doc_id", "ids", "part", "tie"), None, len(parts), ["tie"]
    else:  # ranges of doc_id of about equally many rows; equal ids are never parted
        shards = max(1, min(-(-int(total.sum()) // SHARD_IDS), MOST_SHARDS))
        steps = [i / shards for i in range(1, shards)]
        cuts = np.unique(raw.approxQuantile("doc_id", steps, 0.25 / shards)).astype(np.int64) if steps else np.empty(0, np.int64)
        raw, n_parts, order = raw.select("doc_id", "ids"), len(cuts) + 1, ["doc_id", "tie", "n"]
    coded = raw.mapInArrow(_code(enc.dtype, rank_of, cuts), "doc_id long, n long, tie long, control binary, data binary, part int")
    ordered = coded.repartitionById(max(1, n_parts), "part").sortWithinPartitions(*order)
    manifest = keep(ordered.mapInArrow(_write(folder), "shard long, docs long, ids long"), "manifest")
    remove(spark, raw_path)
    return manifest


def _read(folder: str):
    def run(batches):
        fs, base = filesystem(folder)
        with fs.open_input_stream(f"{base}/ranks.bin") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/shard-{shard:06d}.tok") as stream:
                    for docs, counts, ranks in frames(stream):
                        ids = by_rank[ranks].astype("<u4").tobytes()
                        ends = np.cumsum(counts)
                        crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([docs, pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1])

    return run


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards, start, rows = sorted(manifest.select("shard", "ids").collect()), 0, []  # one small row a shard
    for shard, n in shards:
        rows.append((shard, start))
        start += n
    if not rows:
        return spark.createDataFrame([], schema)
    each = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "shard long, start long")
    return each.mapInArrow(_read(folder), schema)


def token_files(docs: DataFrame, tokenizer: str, cached: int = CACHED, as_read: bool = False, part: int | None = None) -> DataFrame:
    """Write `docs` to token files in the shared folder and return what reading them back gives, a row per row of
    `docs`. `cached` bounds the units that a worker remembers, and again those on probation, `part` the characters that it
    parts at once; less of them take less memory and more time."""
    spark = docs.sparkSession
    folder = work_path(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, tokenizer, folder, cached, as_read, part), folder)
