"""Token counts as delta-maintained rollups.

A batch holds signed changes: an insert adds a document's count, a delete takes it away, a revision does
both. A batch is reduced to additive totals by source, language and tokenizer version and committed under
its id; totals are the sums over committed batches. Committing an id again changes nothing, so a batch whose
driver died can simply be sent again. Compaction folds batches into a base that remembers their ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD

KEYS = ["source", "lang", "tokenizer"]
#: Tokenizer versions as column expressions over a text; null texts have no tokens.
VERSIONS = {"words-1": WORD, "runs-2": r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]+"}
BASE = "base-"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def tokens(text: Column, *versions: str) -> Column:
    """{version: number of tokens} of a text."""
    return F.create_map(*(x for v in versions for x in (F.lit(v), F.coalesce(F.regexp_count(text, F.lit(VERSIONS[v])), F.lit(0)).cast("long"))))


def counted(docs: DataFrame, *versions: str) -> DataFrame:
    """doc_id, source, lang, tokens: what batches are made of. Counting comes before any join, so that only these
    small rows are shuffled and never the texts."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), tokens(F.col("text"), *versions).alias("tokens"))


def changes(rows: DataFrame, sign: int, *versions: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens: one signed row per counted row and version."""
    each = F.array(*(F.struct(F.lit(v).alias("tokenizer"), (F.col("tokens")[v] * sign).alias("n_tokens")) for v in versions))
    return rows.select("source", "lang", F.explode(each).alias("c")).select("source", "lang", "c.tokenizer", F.lit(sign).cast("long").alias("n_docs"), "c.n_tokens")


def revision(before: DataFrame, after: DataFrame, *versions: str) -> DataFrame:
    """The change from one state of some documents to another."""
    return changes(before, -1, *versions).unionByName(changes(after, 1, *versions))


class Rollup:
    """Totals below `folder`: one sub-folder a batch, and generations of a base that batches were folded into. Batch
    ids are letters, digits, - and _. A folder counts once it has its name: it is written under another one and
    renamed, so of two drivers that commit the same batch one wins and a reader sees all of it or nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self) -> list[str]:
        fs, path = self._files()
        if not fs.exists(path(self.folder)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.folder)) if s.isDirectory())

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches in it."""
        bases = [n for n in self._names() if n.startswith(BASE)]
        if not bases:
            return None, set()
        folded = self.spark.read.schema("batch string").parquet(f"{self.folder}/{bases[-1]}/batches").collect()  # a small row a batch
        return bases[-1], {r.batch for r in folded}

    def _put(self, name: str, write) -> bool:
        """What `write` leaves in a fresh folder under `name`; false if that is taken."""
        fs, path = self._files()
        scratch = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        write(scratch)
        taken = path(f"{self.folder}/{name}")
        done = not fs.exists(taken) and fs.rename(path(scratch), taken)
        if not done:
            fs.delete(path(scratch), True)
        return done

    def committed(self, batch: str) -> bool:
        return batch in self._names() or batch in self._base()[1]

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch; false if its id is committed already. An interrupted commit leaves nothing that counts, so
        it can simply be sent again."""
        if not batch.replace("-", "").replace("_", "").isalnum() or batch.startswith(BASE):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self._put(batch, lambda path: sums.write.parquet(path))

    def batches(self) -> list[str]:
        """Ids of the committed batches that no base holds yet."""
        folded = self._base()[1]
        return [n for n in self._names() if not n.startswith((BASE, ".", "_")) and n not in folded]

    def compact(self) -> bool:
        """Fold all batches into a new base, so that totals read two tables however many batches there were. Their
        ids stay known. What the new base holds is deleted after it counts; false if there was nothing to fold."""
        old, folded = self._base()
        new = self.batches()
        if not new:
            return False
        sums, ids = self.totals(), self.spark.createDataFrame([(b,) for b in sorted(folded | set(new))], "batch string")

        def write(path):
            sums.write.parquet(f"{path}/totals")
            ids.coalesce(1).write.parquet(f"{path}/batches")

        if not self._put(f"{BASE}{int(old.removeprefix(BASE)) + 1 if old else 0:09d}", write):
            return False
        fs, path = self._files()
        for name in [*new, *([old] if old else [])]:
            fs.delete(path(f"{self.folder}/{name}"), True)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over the base and all later batches, without groups of no
        documents and tokens.

        Null sources and languages are groups of their own; texts that are null or empty count as documents of
        no tokens; without batches the result is empty."""
        base, _ = self._base()
        paths = [f"{self.folder}/{b}" for b in self.batches()] + ([f"{self.folder}/{base}/totals"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        sums = self.spark.read.schema(TOTALS).parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")
