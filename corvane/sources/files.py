"""Trees of files written from rows, all or nothing by file: a Python data source with a two-phase commit.

A task stages its files below `<root>/_staging/<job>/<attempt>` with a manifest of where they go. Nothing is in place
before all tasks have ended; then the job is marked as committed and the manifests are followed, one at a time, by
renames. A job that fails leaves nothing in place: it sets a mark, by which tasks that are still running know to clear
what they have staged. A job that is interrupted amid its renames is finished by `recover`, which takes marks away too.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "file_tree"
STAGING = "_staging"
PER_FILE = 1 << 16  # what opening a file costs, in bytes
CHUNK = 1 << 20  # what is read of a file at once
_COMMITTED, _ABORTED, _MANIFEST = "committed", ".aborted", "manifest.jsonl"
_BAD_PATH = re.compile(r"^/|(^|/)\.{0,2}(/|$)|\x00")


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", root) if ":" in root else "file://" + root)


def _read(fs: pafs.FileSystem, path: str) -> bytes | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def _write(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    with fs.open_output_stream(path) as f:
        f.write(content)


def _remove(fs: pafs.FileSystem, path: str) -> None:
    for _ in range(5):  # a task may write into it meanwhile
        if fs.get_file_info(path).type != pafs.FileType.Directory:
            return
        try:
            return fs.delete_dir(path)
        except OSError:
            time.sleep(0.2)


def _publish(fs: pafs.FileSystem, base: str, attempt: str) -> None:
    """Follow an attempt's manifest; a file that isn't staged any more is in place already."""
    manifest = _read(fs, f"{attempt}/{_MANIFEST}") or b""
    for line in manifest.splitlines():
        staged, path = json.loads(line)
        if fs.get_file_info(f"{attempt}/{staged}").type == pafs.FileType.File:
            fs.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
            fs.move(f"{attempt}/{staged}", f"{base}/{path}")


@dataclass
class Staged(WriterCommitMessage):
    """What a task tells the driver: where its manifest is, and counts."""

    attempt: str
    written: int
    unchanged: int
    kept: int


def _chunks(fs: pafs.FileSystem, path: str):
    with fs.open_input_stream(path) as f:
        while part := f.read(CHUNK):
            yield part


def _same(fs: pafs.FileSystem, a: str, b: str) -> bool:
    one, other = fs.get_file_info([a, b])
    return one.type == other.type == pafs.FileType.File and one.size == other.size and all(x == y for x, y in zip(_chunks(fs, a), _chunks(fs, b), strict=True))


def _runs(batch: pa.RecordBatch):
    """path, once, first and the bytes of each stretch of rows of one path; a row with `first` begins a stretch too."""
    path, content, once, first = (batch.column(c) for c in ("path", "content", "once", "first"))
    n = batch.num_rows
    if not n:
        return
    if path.null_count:
        raise ValueError("not a path below the root: None")
    change = np.ones(n, bool)
    change[1:] = pc.not_equal(path.slice(1), path.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    begins = pc.fill_null(first, False).to_numpy(zero_copy_only=False)
    text = pc.fill_null(content, "").cast(pa.large_binary())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = memoryview(text.buffers()[2] or b"")
    starts = np.flatnonzero(change | begins)
    for i, j in zip(starts, [*starts[1:], n], strict=True):
        yield path[i].as_py(), bool(once[i].as_py()), bool(begins[i]), data[at[i] : at[j]]


class LineTreeWriter(DataSourceArrowWriter):
    """Rows of a path follow each other and are pieces of one file, which is never held as a whole."""

    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator) -> Staged:
        fs, base = _store(self.root)
        name = uuid.uuid4().hex
        attempt, counts, manifest = f"{base}/{STAGING}/{self.job}/{name}", {"written": 0, "unchanged": 0, "kept": 0}, []
        at, out, n = None, None, 0

        def close() -> None:
            if out is None:
                return
            out.close()
            if _same(fs, f"{attempt}/{n}", f"{base}/{at}"):
                fs.delete_file(f"{attempt}/{n}")
                counts["unchanged"] += 1
            else:
                manifest.append(json.dumps([str(n), at]))
                counts["written"] += 1

        try:
            fs.create_dir(attempt, recursive=True)
            for batch in iterator:
                for path, once, first, data in _runs(batch):
                    if path == at and first:
                        raise ValueError(f"two files of one path: {path!r}")
                    if path != at:
                        close()
                        if not path or _BAD_PATH.search(path) or path.split("/")[0] == STAGING:
                            raise ValueError(f"not a path below the root: {path!r}")
                        at, n, out = path, n + 1, None
                        if once and fs.get_file_info(f"{base}/{path}").type == pafs.FileType.File:
                            counts["kept"] += 1
                        else:
                            out = fs.open_output_stream(f"{attempt}/{n}", buffer_size=CHUNK)
                    if out is not None and len(data):
                        out.write(data)
            close()
            if manifest:
                _write(fs, f"{attempt}/{_MANIFEST}", "\n".join(manifest).encode())
            else:
                _remove(fs, attempt)
            if _read(fs, f"{base}/{STAGING}/{self.job}{_ABORTED}") is not None:
                raise RuntimeError("the job was aborted")
        except BaseException:
            _remove(fs, attempt)
            raise
        return Staged(name if manifest else "", **counts)

    def commit(self, messages) -> None:
        _commit(self, messages)

    def abort(self, messages) -> None:
        _abort(self)


def _commit(writer, messages) -> None:
    fs, base = _store(writer.root)
    job = f"{base}/{STAGING}/{writer.job}"
    done = [m.attempt for m in messages if m and m.attempt]
    if done:
        _write(fs, f"{job}/{_COMMITTED}", "\n".join(done).encode())
        for name in done:
            _publish(fs, base, f"{job}/{name}")
    _remove(fs, job)


def _abort(writer) -> None:
    fs, base = _store(writer.root)
    job = f"{base}/{STAGING}/{writer.job}"
    fs.create_dir(f"{base}/{STAGING}", recursive=True)
    _write(fs, job + _ABORTED, b"")  # a task that ends later sees it, one that ended before is removed here
    _remove(fs, job)


class FileTreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names, self.job = root, names, uuid.uuid4().hex

    def write(self, iterator) -> Staged:
        fs, base = _store(self.root)
        name = uuid.uuid4().hex
        attempt, n, unchanged, kept = f"{base}/{STAGING}/{self.job}/{name}", 0, 0, 0
        manifest = []
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in self.names]
                once = columns[2] if len(columns) > 2 else pa.nulls(batch.num_rows, pa.bool_())
                for path, content, first_only in zip(columns[0], columns[1], once, strict=True):
                    path, content = path.as_py(), (content.as_py() or "").encode()
                    if not path or _BAD_PATH.search(path) or path.split("/")[0] == STAGING:
                        raise ValueError(f"not a path below the root: {path!r}")
                    there = _read(fs, f"{base}/{path}")
                    if there is not None and first_only.as_py():
                        kept += 1
                    elif there == content:
                        unchanged += 1
                    else:
                        if not n:
                            fs.create_dir(attempt, recursive=True)
                        _write(fs, f"{attempt}/{n}", content)
                        manifest.append(json.dumps([str(n), path]))
                        n += 1
            if n:
                _write(fs, f"{attempt}/{_MANIFEST}", "\n".join(manifest).encode())
            if _read(fs, f"{base}/{STAGING}/{self.job}{_ABORTED}") is not None:
                raise RuntimeError("the job was aborted")
        except BaseException:
            _remove(fs, attempt)
            raise
        return Staged(name if n else "", n, unchanged, kept)

    def commit(self, messages) -> None:
        _commit(self, messages)

    def abort(self, messages) -> None:
        _abort(self)


@dataclass
class Paths(InputPartition):
    """Files that one task reads."""

    paths: list[str]


class FileTreeReader(DataSourceReader):
    """Hidden folders and empty files too, which Spark's own readers leave out; nothing that is staged."""

    def __init__(self, root: str, most_bytes: int, digest: str = ""):
        self.root, self.most_bytes, self.digest = root, most_bytes, digest

    def partitions(self) -> list[Paths]:
        fs, base = _store(self.root)
        out, size = [Paths([])], 0
        for info in sorted(fs.get_file_info(pafs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            path = info.path[len(base.rstrip("/")) + 1 :]
            if info.type != pafs.FileType.File or path.split("/")[0] == STAGING:
                continue
            if out[-1].paths and size + info.size + PER_FILE > self.most_bytes:
                out.append(Paths([]))
                size = 0
            out[-1].paths.append(path)
            size += info.size + PER_FILE
        return out

    def read(self, partition: Paths):
        fs, base = _store(self.root)
        for at in range(0, len(partition.paths), 100):
            paths = partition.paths[at : at + 100]
            if self.digest:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([self._hash(fs, f"{base}/{p}") for p in paths], pa.string())], ["path", "hash"])
                continue
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([(_read(fs, f"{base}/{p}") or b"").decode(errors="replace") for p in paths], pa.string())], ["path", "content"])


    def _hash(self, fs: pafs.FileSystem, path: str) -> str:
        found = hashlib.new(self.digest)
        for part in _chunks(fs, path):
            found.update(part)
        return found.hexdigest()


class FileTree(DataSource):
    """`df.write.format("file_tree").mode("append").save(root)`: path and content, a row a file; files with a true
    `once` are never written over. With `first`, rows of a path are pieces of a file (see `write_lines`). Read with the
    same format; `mostBytes` bounds what one task reads, `digest` gives a hash in place of the content."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, hash string" if self.options.get("digest") else "path string, content string"

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options["path"], int(self.options.get("mostBytes", 16 << 20)), self.options.get("digest", ""))

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        if overwrite:
            raise ValueError("files are written where they differ; use mode append")
        names = [n for n in ("path", "content", "once") if n in schema.fieldNames()]
        if names[:2] != ["path", "content"]:
            raise ValueError("rows need path and content")
        if "first" in schema.fieldNames():
            return LineTreeWriter(self.options["path"])
        return FileTreeWriter(self.options["path"], names)


def write_tree(files: DataFrame, root: str) -> None:
    """Write path, content and, if there, once (true: only if no such file exists). Files that are the same stay as they
    are, with their times. A path that comes twice is an error, and so is one that leads out of the root; nothing is
    written then. A null content is an empty file; other columns play no part."""
    spark = files.sparkSession
    columns = [c for c in ("path", "content", "once") if c in files.columns]
    twice = files.groupBy("path").count().where("count > 1").select("path").first()
    if twice is not None:
        raise ValueError(f"two files of one path: {twice.path!r}")
    spark.dataSource.register(FileTree)
    files.select(*columns).write.format(FORMAT).mode("append").save(root)


def write_lines(lines: DataFrame, root: str, placed: DataFrame | None = None) -> None:
    """Write files from their pieces: path, section, k, line, end (what follows a line), once and first. A file is written
    by one task, piece by piece in the order of section, k and line, so that memory doesn't grow with it. Its first
    piece has a true `first`; a second such piece is another file of the path, which is an error. `placed` has pieces of
    other files, all pieces of a path in one partition already, which aren't shuffled again. Otherwise as `write_tree`."""
    lines.sparkSession.dataSource.register(FileTree)
    rows = lines.repartition("path")
    if placed is not None:
        rows = rows.unionByName(placed.select(*rows.columns))
    rows = rows.sortWithinPartitions("path", "section", "k", "line")
    rows.select("path", F.concat("line", F.coalesce("end", F.lit(""))).alias("content"), "once", "first").write.format(FORMAT).mode("append").save(root)


def recover(root: str) -> None:
    """Finish jobs that were interrupted once they had been committed, and clear what others left."""
    fs, base = _store(root)
    jobs = fs.get_file_info(pafs.FileSelector(f"{base}/{STAGING}", allow_not_found=True))
    for job in jobs:
        if job.type == pafs.FileType.File:
            fs.delete_file(job.path)
            continue
        for name in (_read(fs, f"{job.path}/{_COMMITTED}") or b"").decode().split():
            _publish(fs, base, f"{job.path}/{name}")
        _remove(fs, job.path)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), content of the files in place."""
    spark.dataSource.register(FileTree)
    return spark.read.format(FORMAT).load(root)


def read_hashes(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), hash (SHA-256 of the bytes) of the files in place, read a piece at a time."""
    spark.dataSource.register(FileTree)
    return spark.read.format(FORMAT).option("digest", "sha256").load(root)
