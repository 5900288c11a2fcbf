"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are laid end to end in a shuffled order, twice over, and cut into blocks of equally
many words. A schedule of slots, one block each, takes its sources from the points frac(i * golden ratio),
mapped through the cumulative weights; the k-th slot of a source takes its k-th block. Any prefix of the
schedule is close to the target mix, and so is any contiguous part of the output.

Ranks and offsets within a source, which may hold a third of all rows, come from two levels of prefix sums:
totals by bucket first, then running sums inside buckets of bounded size.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, keep, mark, release

SHARE = Fraction(3, 2)
WEIGHTS = (3, 1, 2)
MOST = 2
BLOCK_WORDS = 1024
BUCKET_ROWS = 20_000
PART_WORDS = 1 << 22
MOST_PARTS = 100_000  # beyond, parts grow; they are sorted with spilling
CHUNK = 1 << 16
BROADCAST_SOURCES = 10_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def targets(sizes: dict[str | None, int], share: Fraction = SHARE) -> dict[str | None, Fraction]:
    """Words to take by source. Sources in code-point order, null last, weigh 3, 1, 2, repeating; no target
    exceeds twice its source's size, and the excess goes to the others by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        scale = Fraction(left, sum(weight[s] for s in free))
        above = {s for s in free if scale * weight[s] > MOST * sizes[s]}
        if not above:
            return out | {s: scale * weight[s] for s in free}
        for s in above:
            out[s] = Fraction(MOST * sizes[s])
            left -= out[s]
        free -= above
    return out


def prefix(df: DataFrame, group: str, bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over earlier rows of the group. Buckets ascend within a group, so only
    their totals are summed across a group and only a bucket's rows are sorted together."""
    df = df.withColumn("_v", value)
    totals = df.groupBy(group, bucket).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, bucket, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(totals, [group, bucket])
    return df.withColumn(name, F.col("_b") + F.col("_i")).drop("_v", "_i", "_b")


def _points(edges: np.ndarray, keys: list[str]):
    def run(batches):
        names = pa.array(keys, pa.string())
        for batch in batches:
            i = np.asarray(batch.column(0)).astype(np.uint64)
            x = (i + np.uint64(1)) * _GOLDEN
            slot = np.searchsorted(edges, x, "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(slot))], ["position", "key"])

    return run


def schedule(spark: SparkSession, slots: dict[str, int]) -> DataFrame:
    """position, key, rank: the slots in order, each with its source and its rank within the source. It goes
    on until each source has as many as asked for; later slots of a full source are left out."""
    keys = [k for k, n in sorted(slots.items()) if n > 0]
    total = sum(slots[k] for k in keys)
    if not total:
        return spark.createDataFrame([], "position long, key string, rank long")
    sums, edges = 0, []
    for k in keys[:-1]:
        sums += slots[k]
        edges.append((sums << 64) // total)
    edges = np.array(edges, np.uint64)
    length = total + total // 50 + 3 * len(keys)
    while True:
        parts = max(1, min(-(-length // CHUNK), 10_000))
        points = spark.range(0, length, 1, parts).mapInArrow(_points(edges, keys), "position long, key string")
        counts = {r.key: r.n for r in points.groupBy("key").agg(F.count("*").alias("n")).collect()}  # a row a source
        if all(counts.get(k, 0) >= slots[k] for k in keys):
            break
        length += length // 4 + len(keys)
    ranked = prefix(points.withColumn("chunk", F.floor(F.col("position") / CHUNK)), "key", "chunk", ["position"], F.lit(1), "rank")
    need = _by_source(spark, [(k, slots[k]) for k in keys], "key string, need long")
    return ranked.join(need, "key").where("rank < need").select("position", "key", "rank")


def _by_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One row a source; broadcast only if they are few."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_SOURCES else df


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _base(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("tie"))
    same = Window.partitionBy("doc_id").orderBy("source", "tie")
    return keep(rows.withColumn("nth", F.row_number().over(same)).drop("tie"), "sizes")


def pieces(base: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, dict, dict]:
    """The mix as (position, doc_id, nth, size, again, from_word, words), with sizes and targets by source.

    base: doc_id, nth, source, size. `again` is false for the first pass over a source and true for the
    second; a piece is the part of a document that lies in the block of a slot."""
    spark = base.sparkSession
    rows = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    sizes = {r.source: int(r["size"]) for r in rows}
    goal = targets(sizes)
    of = {(("s" + s) if s is not None else "n"): s for s in sizes}
    words = {k: min(round(goal[s]), MOST * sizes[s]) for k, s in of.items()}
    bits = max(1, (sum(r.n for r in rows) // BUCKET_ROWS).bit_length())
    shuffled = base.where("size > 0").withColumn("key", _key()).withColumn("h", F.xxhash64(F.lit("mix"), "doc_id", "nth"))
    shuffled = shuffled.withColumn("bucket", F.shiftright("h", 64 - bits))
    laid = prefix(shuffled, "key", "bucket", ["h", "doc_id", "nth"], F.col("size"), "at").select("doc_id", "nth", "key", "size", "at")
    lengths = _by_source(spark, [(k, words[k], sizes[s]) for k, s in of.items()], "key string, take long, whole long")
    both = laid.withColumn("again", F.explode(F.array(F.lit(False), F.lit(True)))).join(lengths, "key")
    both = both.withColumn("at", F.col("at") + F.when(F.col("again"), F.col("whole")).otherwise(0))
    both = both.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("take"))).where("at < end")
    cut = both.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    first, last = F.greatest("at", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    cut = cut.select("key", "rank", "doc_id", "nth", "size", "again", (first - F.col("at")).alias("from_word"), (last - first).alias("words"))
    slots = schedule(spark, {k: -(-n // block) for k, n in words.items()})
    return cut.join(slots, ["key", "rank"]).select("position", "doc_id", "nth", "size", "again", "from_word", "words"), sizes, goal


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, size, source_size, target, taken, first_position,
    n_pieces.

    size counts words (null: 0). The schedule deals the slots; taken sums the words of the row's pieces in all
    slots that it got, repeats included, at most twice its size; first_position is the first of these slots
    (null: none) and n_pieces their number. The words taken of a source are its target, rounded. Rows that
    repeat a doc_id are mixed each; a null source is a source of its own and a null doc_id a row like others; an
    empty table gives an empty table. Other columns aren't looked at. Reruns agree: the shuffle depends on the
    ids only."""
    spark = docs.sparkSession
    base = _base(docs)
    mixed, sizes, goal = pieces(base)
    taken = mixed.groupBy("doc_id", "nth").agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"), F.count("*").alias("n_pieces"))
    known = [(("s" + s) if s is not None else "n", sizes[s], float(goal[s])) for s in sizes]
    out = base.withColumn("key", _key()).join(_by_source(spark, known, "key string, source_size long, target double"), "key")
    match = out["doc_id"].eqNullSafe(taken["doc_id"]) & (out["nth"] == taken["nth"])
    none = F.lit(0).cast("long")
    return out.join(taken, match, "left").select(out["doc_id"], "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_position", F.coalesce("n_pieces", none).alias("n_pieces"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; all of it, if it has no more words."""
    gap = r"[\x20\x09-\x0D]+"
    limit = n + 1 + text.rlike("^" + gap).cast("int")
    parts = F.split(text, gap, limit)
    cut = F.substr(text, F.lit(1), F.length(text) - F.length(F.element_at(parts, -1)))
    return F.when(F.size(parts) < limit, text).otherwise(F.regexp_replace(cut, gap + "$", ""))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """`docs` in the order of the mix, partition after partition: a document once for each pass that takes words
    of it, at the first slot it got, with all of its columns.

    A document is whole, but for the last one of a source, of which the mix takes a part: its text ends after the
    words taken (and n_chars, where there is such a column, follows). So a source's words are its target, rounded,
    and any stretch of the result is near the weights, up to the length of a document and a few blocks a source.
    Documents without words are in no block and go, nulls among them. Null ids and sources, and rows that repeat
    an id, are mixed like others; an empty table gives an empty table. The result keeps its order when it is
    written to files, one per partition."""
    since = mark()
    base = _base(docs)
    repeats = base.where("nth > 1").limit(1).count() > 0
    mixed, _, _ = pieces(base)
    copies = mixed.groupBy("doc_id", "nth", "again").agg(F.min("position").alias("position"), F.sum("words").alias("words"), F.first("size").alias("size"))
    copies = keep(copies.select(F.col("doc_id").alias("_copy"), "nth", "position", "words", "size"), "copies")
    release(since)
    whole = copies.agg(F.sum("words").alias("words"), F.max("position").alias("last")).first()
    parts = max(1, min(-(-(whole.words or 0) // PART_WORDS), MOST_PARTS))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    match = F.col("_id").eqNullSafe(F.col("_copy"))
    if repeats:  # only then are texts sorted
        same = Window.partitionBy("_id").orderBy(F.col("_row.source").cast("string"), F.xxhash64("_row.text"))
        rows = rows.withColumn("_nth", F.row_number().over(same))
        match = match & (F.col("_nth") == F.col("nth"))
    found = rows.join(copies, match)
    # Slots are equally long, so ranges of them are partitions of about equally many words.
    found = found.withColumn("_part", F.floor(F.col("position") * parts / ((whole.last or 0) + 1)).cast("int"))
    found = found.repartitionById(parts, "_part").sortWithinPartitions("position", "_id", "nth")
    part = F.col("words") < F.col("size")
    text = F.when(part, first_words(F.col("_row.text"), F.col("words").cast("int"))).otherwise(F.col("_row.text"))
    shown = {c: F.col("_row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(part, F.length(text)).otherwise(F.col("_row.n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return found.select(*(shown[c].alias(c) for c in docs.columns))
