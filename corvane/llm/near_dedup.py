"""Near-duplicate groups by min-max hashing.

Each document is the set of its distinct k-word shingles. Under every random permutation both the
smallest and the largest hash are kept, so P permutations give 2P unbiased signature values. Bands of
four values bring pairs together; every candidate link is confirmed on the full sets.

The work stays linear on hot groups: documents with equal sets become one class; a bucket proposes
links to its leader (a star, not all pairs), first the smallest id and then the largest; the members of
buckets that still hold several components after that go through an exact prefix-filter join, which
proposes only pairs across components that share a rare shingle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, mark, mix, release, shingles, small, word_hashes

BAND_VALUES = 4
BLOCK = 256
VOCABULARY = 1 << 15
MAP_BITS = 1 << 24
COMMON = 32  # sets that hold an element before it counts as common; any value gives the same groups
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 512, dtype=np.uint64)
_K = _rng.integers(1, 2**63, (256, BAND_VALUES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(values: np.ndarray, permutations: int) -> np.ndarray:
    """2 * permutations values: min and max of every permutation, side by side."""
    out = np.empty((permutations, 2), np.uint64)
    low, high = np.full(permutations, 2**64 - 1, np.uint64), np.zeros(permutations, np.uint64)
    for at in range(0, len(values), 8192):
        h = values[None, at : at + 8192] * _A[:permutations, None] + _B[:permutations, None]
        low, high = np.minimum(low, h.min(1)), np.maximum(high, h.max(1))
    out[:, 0], out[:, 1] = low, high
    return out.ravel()


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    signature = min_max(values, bands * BAND_VALUES // 2).reshape(bands, BAND_VALUES)
    keys = (signature * _K[:bands]).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    return mix(keys).view(np.int64)


def _signer(k: int, bands: int):
    def run(batches):
        for batch in small(batches):
            ids, texts, ties = batch.column(0), batch.column(1), batch.column(2)
            n, digests, keys = [], [], []
            for text in texts:
                s = shingles(word_hashes(text.as_py())[0], k)
                n.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                keys.append(band_keys(s, bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, ties, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "tie", "n_shingles", "digest", "bands"],
            )

    return run


def _digest(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def _setter(k: int, marked: np.ndarray):
    """Sets of the documents whose id's bit is marked: all that are wanted, and a few more."""

    def run(batches):
        for batch in small(batches):
            place = np.asarray(batch.column(2))
            rows = np.flatnonzero(marked[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1))
            texts = batch.column(1)
            sets = [shingles(word_hashes(texts[i].as_py())[0], k).view(np.int64) for i in rows.tolist()]
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "digest", "elements"])

    return run


def _sets(texts: Texts, wanted: DataFrame, k: int) -> DataFrame:
    """(node, elements): full shingle sets of at least the classes in `wanted` (node).

    A bit map of their hashed ids, of MAP_BITS at most, goes to the workers, so that texts aren't shuffled
    and sets are made where the texts are read. A map too small for its ids only lets more sets through."""
    if texts.renumbered:
        wanted = wanted.join(texts.classes, "node").select("doc_id").distinct()
    else:
        wanted = wanted.select(F.col("node").alias("doc_id"))
    n = wanted.count()
    bits = max(1 << 16, min(MAP_BITS, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.lit("map"), "doc_id"), F.lit(bits))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m")).toArrow()
    marked = np.zeros(bits // 64, np.uint64)
    marked[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    found = texts.source.where("doc_id IS NOT NULL").select("doc_id", "text", place.alias("place")).mapInArrow(_setter(k, marked), "doc_id long, digest binary, elements array<long>")
    if texts.renumbered:
        found = found.join(texts.classes.select("doc_id", "digest", "node"), ["doc_id", "digest"])
    else:
        found = found.withColumnRenamed("doc_id", "node")
    if texts.repeated:
        found = found.dropDuplicates(["node"])
    return keep(found.select("node", "elements"), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that reaches a smaller one; roots have no row.

    Large-star and small-star rounds on the edge list, each a keyed minimum and a join, until every edge
    leads to the root of a star. The minima are written before they are joined: then a node of very many
    edges is a skewed key of a plain join, which adaptive execution splits over tasks."""
    current = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _is_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        current = keep(small.where("u <> v").distinct(), "edges")
    return current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def _is_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    sides = edges.select("u", F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out")))
    return not sides.groupBy("u").agg(F.sum("out").alias("n"), F.min("out").alias("low")).where("n > 1 OR (n = 1 AND low = 0)").limit(1).count()


@dataclass(frozen=True)
class Texts:
    """Documents by class of equal sets. source: doc_id, text, tie. signed: doc_id, tie, n_shingles, digest, bands.
    classes: digest, doc_id (the least), node. Nodes ascend with that doc_id and are it, unless some id has
    several sets (`renumbered`). `repeated` tells whether any id has several rows."""

    source: DataFrame
    signed: DataFrame
    classes: DataFrame
    repeated: bool
    renumbered: bool


def _classed(docs: DataFrame, k: int, bands: int, tie) -> Texts:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), tie.alias("tie"))
    signed = keep(source.mapInArrow(_signer(k, bands), "doc_id long, tie binary, n_shingles long, digest binary, bands array<long>"), "signed")
    usable = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    ids = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("c > 1")
    found = ids.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("d0") != F.col("d1")), F.lit(False)).alias("differ")).first()
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    if found.differ:
        classes = classes.orderBy("doc_id", "digest").withColumn("node", F.monotonically_increasing_id())
    else:
        classes = classes.withColumn("node", F.col("doc_id"))
    return Texts(source, signed, keep(classes, "classes"), bool(found.n), found.differ)


def _linked(texts: Texts, k: int, percent: int) -> list[DataFrame]:
    """Links (a, b) between nodes that connect what is connected.

    Whatever a hot key is joined with is written first, and no step above such a join needs the key's rows
    together: so the join reads two plain shuffles, and adaptive execution splits a skewed key."""
    usable = texts.signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    nodes = usable.join(texts.classes, ["doc_id", "digest"])
    if texts.repeated:
        nodes = nodes.dropDuplicates(["doc_id", "digest"])
    rows = keep(nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")), "bands")
    several = keep(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    rows = keep(rows.join(several, "key"), "buckets")

    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sizes alone can rule a link out
    links, tested, labels = [], [], None
    for pick in (F.min, F.max):
        now = _mixed(rows, labels)
        lead = keep(now.groupBy("key").agg(pick(F.struct("node", "n", "label")).alias("lead")), "leads")
        pairs = now.join(lead, "key").where(F.col("node") != F.col("lead.node")).where(F.col("label") != F.col("lead.label"))
        pairs = pairs.where(fits(F.col("n"), F.col("lead.n"))).select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        pairs = pairs.distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        tested.append(pairs)
        links.append(_confirmed(_sets(texts, _ends(pairs), k), pairs, percent))
        labels = components(reduce(DataFrame.unionByName, links))
    # What stars could not settle: an exact join over the members of buckets that are still mixed.
    rest = keep(_mixed(rows, labels).select("node", "label").distinct(), "rest")
    return [*links, *_settled(rest, _sets(texts, rest.select("node"), k), percent)]


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A n B| >= percent * |A u B| over their shingle sets.
    component_id is the smallest doc_id reachable by links, the row's own included. Null, empty and
    word-less texts have n_shingles 0 and are linked with nothing. Repeated rows and equal sets share a
    component, and so do rows that repeat a doc_id, whose texts are all compared. A null doc_id stays alone:
    component_id null, kept. An empty table gives an empty table; columns other than doc_id and text are not
    looked at.

    Banding is the only step that can lose a link: with 24 bands of 4 values a pair at exactly 0.8
    shares no bucket with probability 3e-6. Links are confirmed on the full sets.
    """
    texts = _classed(docs, k, bands, F.lit(b""))
    usable = texts.signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    members = usable.select("doc_id", "digest").join(texts.classes.select("digest", "node"), "digest").select("doc_id", "node")
    if texts.repeated:
        members = keep(members.distinct(), "members")
    since = mark()
    links = _linked(texts, k, percent)
    if texts.repeated:
        first = members.groupBy("doc_id").agg(F.min("node").alias("a"))
        links.append(members.join(first, "doc_id").where("node <> a").select("a", F.col("node").alias("b")))
    labels = keep(components(reduce(DataFrame.unionByName, links)), "labels")
    release(since)
    final = members.join(labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    if texts.repeated:
        final = final.distinct()  # the rows of an id are in one component
    if texts.renumbered:
        final = final.join(texts.classes.select(F.col("node").alias("component"), F.col("doc_id").alias("least")), "component").select("doc_id", F.col("least").alias("component"))
    out = texts.signed.select("doc_id", "n_shingles", F.col("digest").isNotNull().alias("linked")).join(final, "doc_id", "left")
    component = F.when(F.col("linked"), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _mixed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold more than one component, with the component as `label`."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    now = keep(rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")
    mixed = keep(now.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key"), "mixed")
    return now.join(mixed, "key")


def _settled(rest: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Links between the components of `rest` (node, label), exact as to what is connected with what.

    With the elements of all sets in one order, rarest first, two sets that pass share an element among
    the first n - ceil(percent * n / 100) + 1 of each, their prefix. There are two cases.
    - They share a rare element of their prefixes: pairs are made for elements of less than COMMON sets.
    - They share only common elements. Then the overlap depends on the sets' common parts alone. Sets of
      equal common parts form a class; for these the best partner is the smallest set, in the own class or
      in another. So classes meet by their smallest sets, block against block, and each other set meets its
      own class's and that of the class which admits the largest sets: texts around one passage give a star."""
    elements = sets.join(rest.select("node"), "node", "left_semi").select("node", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    counts = keep(elements.groupBy("e").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    elements = keep(elements.join(counts, "e", "left").withColumn("c", F.coalesce("c", F.lit(1))), "elements")
    order = Window.partitionBy("node").orderBy("c", "e")
    prefix = elements.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = keep(prefix.where("c > 1").join(rest, "node").select("e", "c", "node", "n", "label"), "prefix")
    rare = keep(_meet(prefix.where(F.col("c") < COMMON), percent), "pairs")

    touched = prefix.where(F.col("c") >= COMMON).select("node", "n", "label").distinct()
    parts = elements.where(F.col("c") >= COMMON).join(touched.select("node"), "node", "left_semi").groupBy("node")
    parts = parts.agg(F.struct(F.count("*"), F.sum(F.xxhash64("e").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "e"))).alias("part"))
    members = keep(touched.join(parts, "node"), "parts")
    least = keep(members.groupBy("part").agg(F.min(F.struct("n", "node", "label")).alias("least")), "least")
    members = keep(members.join(least, "part"), "classes")
    star = members.where("node <> least.node AND label <> least.label").select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"))
    heads = members.where("node = least.node").select("node", "n", "label")
    shared = prefix.where(F.col("c") >= COMMON).join(heads.select("node"), "node", "left_semi").select("e", "node")
    first = keep(shared.groupBy("e").agg(F.min("node").alias("b")), "first")
    groups = components(shared.join(first, "e").select(F.col("node").alias("a"), "b"))
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    common = elements.where(F.col("c") >= COMMON).join(groups, "node").groupBy("node", "component").agg(F.collect_list("e").alias("common"))
    met = keep(_blocks(common.join(heads, "node"), percent), "blocks")
    classes = met.where("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    admits = keep(met.where("NOT linked").groupBy("a").agg(F.max(F.struct("t", "b")).alias("best")), "admits")
    others = members.where("node <> least.node").join(admits, F.col("least.node") == F.col("a")).where(F.col("n") * percent <= F.col("best.t"))
    others = others.select(F.least("node", "best.b").alias("a"), F.greatest("node", "best.b").alias("b"))
    pairs = keep(rare.unionByName(classes).unionByName(star).unionByName(others).distinct(), "pairs")
    return [_confirmed(sets, pairs, percent)]


def _blocks(heads: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, t) for heads (node, n, label, component, common) of one group, block by block.

    Blocks of about BLOCK sets meet within their group and their overlaps come from one matrix product;
    a pair of blocks returns at most a spanning forest of links, and each head's best partner."""
    heads = keep(heads, "heads")
    count = keep(heads.groupBy("component").agg(F.count("*").alias("k")).where("k > 1"), "groups")
    rows = heads.join(count, "component").withColumn("parts", F.ceil(F.col("k") / BLOCK)).withColumn("i", F.pmod(F.xxhash64("node"), "parts"))
    packed = rows.groupBy("component", "parts", "i").agg(*(F.collect_list(F.struct("node", "n", "label", "common")).alias("sets"),))
    left = packed.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("parts") - 1)))
    right = packed.select("component", F.col("i").alias("j"), F.col("sets").alias("others"))
    return left.join(right, ["component", "j"]).select("sets", "others", (F.col("i") == F.col("j")).alias("same")).mapInArrow(_block_pairs(percent), "a long, b long, linked boolean, t long")


def _packed(sets: pa.ListScalar) -> tuple[np.ndarray, ...]:
    """(node, n, label, set by element, elements) of one block."""
    rows = sets.values
    lists = rows.field("common")
    whose = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
    return (*(rows.field(c).to_numpy().astype(np.int64) for c in ("node", "n", "label")), whose, lists.flatten().to_numpy())


def _overlap(whose_x: np.ndarray, x: np.ndarray, nx: int, whose_y: np.ndarray, y: np.ndarray, ny: int) -> np.ndarray:
    """|a n b| of all pairs of sets, as products of matrices over slices of the vocabulary."""
    out = np.zeros((nx, ny), np.float64)
    vocabulary = np.intersect1d(x, y)
    for at in range(0, len(vocabulary), VOCABULARY):
        words = vocabulary[at : at + VOCABULARY]
        held = []
        for whose, values, n in ((whose_x, x, nx), (whose_y, y, ny)):
            place = np.searchsorted(words, values)
            hit = words[np.minimum(place, len(words) - 1)] == values
            m = np.zeros((n, len(words)), np.float32)
            m[whose[hit], place[hit]] = 1
            held.append(m)
        out += held[0] @ held[1].T
    return np.rint(out).astype(np.int64)


def _block_pairs(percent: int):
    def run(batches):
        for batch in batches:
            for sets, others, same in zip(*(batch.column(i) for i in range(3)), strict=True):
                same = same.as_py()
                x, nx, lx, wx, ex = _packed(sets)
                y, ny, ly, wy, ey = (x, nx, lx, wx, ex) if same else _packed(others)
                overlap = _overlap(wx, ex, len(x), wy, ey, len(y))
                passes = ((100 + percent) * overlap >= percent * (nx[:, None] + ny[None, :])) & (lx[:, None] != ly[None, :])
                root: dict[int, int] = {}

                def find(v, root=root):
                    while root.get(v, v) != v:
                        v = root[v]
                    return v

                out = []
                for i, j in zip(*np.nonzero(passes), strict=True):
                    p, q = find(int(lx[i])), find(int(ly[j]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((int(x[i]), int(y[j]), True, 0))
                room = (100 + percent) * overlap  # percent * n of the largest set that a partner admits, plus the partner's own
                for nodes, mates, t in ((x, y, room - percent * ny[None, :]), (y, x, room.T - percent * nx[None, :])):
                    if same:
                        np.fill_diagonal(t, -1)
                    best = t.argmax(1)
                    out += [(int(nodes[i]), int(mates[j]), False, int(t[i, j])) for i, j in enumerate(best) if t[i, j] >= 0]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "linked", "t"])

    return run


def _meet(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that share an element here and whose sizes allow a link. Pairs within the
    most frequent component of an element are never made, so one large component costs no square."""
    most = prefix.groupBy("e", "label").agg(F.count("*").alias("c")).groupBy("e").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels"))
    most = most.where("labels > 1").select("e", F.col("most.label").alias("most"))
    x, y = prefix.join(most, "e").where("label <> most").alias("x"), prefix.alias("y")
    met = x.join(y, F.expr(f"x.e = y.e AND x.label <> y.label AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets pass."""
    a, b = sets.select(F.col("node").alias("a"), F.col("elements").alias("sa")), sets.select(F.col("node").alias("b"), F.col("elements").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    ok = 100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))
    return keep(both.where(ok).select("a", "b"), "links")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each near-duplicate group: the one of the smallest id.

    Here rows are told apart by id and text, not by id alone: of rows of one id whose texts aren't near
    duplicates each stays. Rows equal in both count as one document; the one whose columns come first as JSON
    stays, and of texts of one id with equal sets the one of the least MD5. Null, empty and word-less texts
    and null ids are in no group and stay. An empty table gives an empty table."""
    tie = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    texts = _classed(docs, k, 24, tie)
    since = mark()
    labels = keep(components(reduce(DataFrame.unionByName, _linked(texts, k, percent))), "labels")
    release(since)
    roots = texts.classes.join(labels.select("node"), "node", "left_anti").select("doc_id", "digest")
    rows = texts.signed.where("doc_id IS NOT NULL").select("doc_id", "tie", "digest")
    stay = rows.where("digest IS NOT NULL").join(roots, ["doc_id", "digest"])
    unnamed = docs.where("doc_id IS NULL")
    if not texts.repeated:
        stay = stay.select("doc_id").unionByName(rows.where("digest IS NULL").select("doc_id"))
        return docs.join(stay, "doc_id", "left_semi").select(*docs.columns).unionByName(unnamed)
    stay = stay.groupBy("doc_id", "digest").agg(F.min("tie").alias("tie")).select("doc_id", "tie")
    stay = stay.unionByName(rows.where("digest IS NULL").select("doc_id", "tie").distinct())
    once = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), F.struct(*docs.columns).alias("row"))
    once = once.join(stay, ["doc_id", "tie"], "left_semi").groupBy("doc_id", "tie").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.select("row.*").unionByName(unnamed)
