"""Collocations by Suffix-sigma: suffixes of three words are shuffled once, sorted, and all their prefixes counted.

Words are known by 64-bit ids. A first scan counts the words of each language; it gives the corpus sizes, the parts of
one word, and two filters of bounded size: words that reach the least count (a suffix ends before any other, since
no phrase with that one can be frequent), and hot words. A second scan makes the suffixes, merges equal ones task by
task and deals them in sorted blocks:

- by language and first word,
- by the second word too where the first is hot,
- by all three where both are hot; the counts of such pairs are partial and are summed afterwards.

So no group holds more suffixes than a word below the hot bound has, or one suffix a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP, bloom, keep, mix, passing, small, word_hashes

# What parts pieces, and what parts words besides.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
LANGUAGE = "und"
LEAST = 10
MOST_BITS = 1 << 25
BUFFER = 3 << 19  # suffixes of a language that a task merges at a time
VOCABULARY = 300_000  # words that a task merges at a time
GROUP = 1 << 16  # suffixes of a group, on average

_PLAIN = bytes(10 if b in BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_NONE = np.uint64(0)


def _other(seed: int) -> bytes | None:
    """Another assignment of bytes for the ids of words; those that part words stay."""
    if not seed:
        return None
    free = np.array([b for b in range(256) if b not in BREAKS + BLANKS])
    table = np.arange(256)
    table[free] = np.random.default_rng(seed).permutation(free)
    return table.astype(np.uint8).tobytes()


def words_of(text: bytes, seed: int = 0) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased text, and id, start, end and piece of each of its words."""
    text = text.translate(_PLAIN)
    other = _other(seed)
    h, start, end = word_hashes(text.translate(other) if other else text, lower=False)
    h = np.where(h == _NONE, np.uint64(1), h)
    piece = np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), start)
    return text, h, start, end, piece


def _by_language(batches, most: int = 2 << 20) -> Iterator[tuple[str, bytes]]:
    """Texts of a language, joined: the line end between two of them parts pieces."""
    for batch in small(batches):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(langs, texts, strict=True):
            text = text.as_py()
            if not text:
                continue
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= most:
                yield lang, b"\n".join(held.pop(lang))
                size[lang] = 0
        for lang, some in held.items():
            yield lang, b"\n".join(some)


def _word_counts(seed: int):
    def run(batches):
        found: dict[str, tuple[dict, dict]] = {}
        held = 0
        for lang, text in _by_language(batches):
            plain, h, start, end, _ = words_of(text, seed)
            ids, at, n = np.unique(h, return_index=True, return_counts=True)
            counts, words = found.setdefault(lang, ({}, {}))
            before = len(counts)
            for i, s, e, k in zip(ids.tolist(), start[at].tolist(), end[at].tolist(), n.tolist(), strict=True):
                if i in counts:
                    counts[i] += k
                else:
                    counts[i], words[i] = k, plain[s:e]
            held += len(counts) - before
            if held >= VOCABULARY:
                yield from _word_rows(found)
                found, held = {}, 0
        yield from _word_rows(found)

    return run


def _word_rows(found) -> Iterator[pa.RecordBatch]:
    for lang, (counts, words) in found.items():
        ids = np.fromiter(counts, np.uint64, len(counts)).view(np.int64)
        n = np.fromiter(counts.values(), np.int64, len(counts))
        texts = list(words.values())
        for at in range(0, len(ids), 1 << 15):
            part = slice(at, at + (1 << 15))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids[part])), pa.array(ids[part]), pa.array(texts[part], pa.binary()).cast(pa.string()), pa.array(n[part])], ["lang", "h", "word", "n"])


def vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, h, word, f) of all words, and the seed of the ids. Should two words of a language share an id, the
    words are counted again under other ids."""
    for seed in range(8):
        rows = texts.mapInArrow(_word_counts(seed), "lang string, h long, word string, n long")
        found = keep(rows.groupBy("lang", "h").agg(F.min("word").alias("word"), F.max("word").alias("_last"), F.sum("n").alias("f")), "words")
        if found.where("word <> _last").isEmpty():
            return found.drop("_last"), seed
    raise ValueError("two words of a language share an id under every seed")


def suffixes(h: np.ndarray, piece: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The suffixes of two words and more that start at each word, cut to three words, at the end of a piece and
    before a word that is not frequent: a row of three ids each, 0 for none."""
    n = len(h)
    if n < 2:
        return np.empty((0, 3), np.uint64)
    two = frequent[:-1] & frequent[1:] & (piece[:-1] == piece[1:])
    three = np.zeros(n - 1, bool)
    three[:-1] = two[:-1] & two[1:]
    at = np.flatnonzero(two)
    third = np.where(three[at], h[np.minimum(at + 2, n - 1)], _NONE)
    return np.stack([h[at], h[at + 1], third], axis=1)


def _blocks(seed: int, frequent: np.ndarray, hot: np.ndarray, groups: int):
    """Sorted blocks of merged suffixes, one a language and group: lang, g, block. Groups of suffixes whose first two
    words are hot have negative numbers."""

    def among(h, table):
        out = np.zeros(len(h), bool)
        out[passing(h, table)] = True
        return out

    def dealt(lang, parts):
        rows = np.concatenate(parts)
        if not len(rows):
            return
        a, b, c = rows.T
        first, second = among(a, hot), among(b, hot)
        both = first & second
        key = a * STEP[0] + np.where(first, b * STEP[1], _NONE) + np.where(both, c * STEP[2], _NONE)
        g = (mix(key) % np.uint64(groups)).astype(np.int64)
        g = np.where(both, -1 - g, g)
        order = np.lexsort((c, b, a, g))[::-1]
        rows, g = rows[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1]).any(1)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(g))).astype(np.uint64)
        rows, g = rows[at], g[at]
        bounds = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        for s in range(0, len(bounds) - 1, 1024):
            cut = bounds[s : s + 1025]
            blocks = [np.column_stack([rows[x:y], n[x:y]]).tobytes("F") for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(blocks)), pa.array(g[cut[:-1]]), pa.array(blocks, pa.binary())], ["lang", "g", "block"])

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for lang, text in _by_language(batches):
            _, h, _, _, piece = words_of(text, seed)
            found = suffixes(h, piece, among(h, frequent))
            held.setdefault(lang, []).append(found)
            size[lang] = size.get(lang, 0) + len(found)
            if sum(size.values()) >= BUFFER:
                largest = max(size, key=size.get)
                yield from dealt(largest, held.pop(largest))
                del size[largest]
        for lang, parts in held.items():
            yield from dealt(lang, parts)

    return run


def prefix_counts(rows: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Suffixes with counts -> (pairs, counts), (triples, counts).

    In reverse order the stack holds the prefixes of the current suffix; where the next suffix parts from it after j
    words, the prefixes longer than j are complete and leave the stack. The places where they leave are found for all
    suffixes at once, and what a prefix gathered lies between two of them."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))[::-1]
    rows, n = rows[order], n[order]
    pair = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))
    triple = pair | np.append(True, rows[1:, 2] != rows[:-1, 2])
    at, at3 = np.flatnonzero(pair), np.flatnonzero(triple)
    pairs, triples = (rows[at, :2], np.add.reduceat(n, at)), (rows[at3], np.add.reduceat(n, at3))
    whole = triples[0][:, 2] != _NONE
    return pairs, (triples[0][whole], triples[1][whole])


_COUNTED = "lang string, a long, b long, c long, n long, partial boolean"


def _counter(least: int):
    """A group's blocks -> its frequent triples (a, b, c) and pairs (c null); partial pairs whatever their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lang, partial = [], None, False
        for batch in batches:
            if batch.num_rows:
                lang, partial = batch.column("lang")[0].as_py(), batch.column("g")[0].as_py() < 0
            parts += [np.frombuffer(b.as_py(), np.uint64).reshape(4, -1).T for b in batch.column("block")]
        rows = np.concatenate(parts)
        (pairs, n), (triples, m) = prefix_counts(rows[:, :3], rows[:, 3].view(np.int64))
        enough = m >= least
        triples, m = triples[enough].view(np.int64), m[enough]
        if not partial:
            enough = n >= least
            pairs, n = pairs[enough], n[enough]
        pairs = pairs.view(np.int64)
        column = lambda i: pa.array(np.concatenate([pairs[:, i], triples[:, i]]))
        third = pa.array(np.concatenate([np.zeros(len(pairs), np.int64), triples[:, 2]]), mask=np.arange(len(pairs) + len(triples)) < len(pairs))
        total = len(pairs) + len(triples)
        out = pa.RecordBatch.from_arrays([pa.array([lang] * total, pa.string()), column(0), column(1), third, pa.array(np.concatenate([n, m])), pa.array(np.append(np.full(len(pairs), partial), np.zeros(len(triples), bool)))], [c.split()[0] for c in _COUNTED.split(", ")])
        for at in range(0, total, 1 << 16):
            yield out.slice(at, 1 << 16)

    return run


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs (text, lang) -> sizes (lang, total), words (lang, h, word, f), pairs (lang, a, b, n) and triples (lang, a,
    b, c, n) of at least `least` occurrences, counted within pieces."""
    texts = docs.select(F.coalesce("lang", F.lit(LANGUAGE)).alias("lang"), "text")
    words, seed = vocabulary(texts)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("total"))
    n = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    frequent = words.where(F.col("f") >= least)
    hot = words.where(F.col("f") > min(1 << 20, max(GROUP, n >> 8)))
    blocks = texts.mapInArrow(_blocks(seed, bloom(frequent, "h", MOST_BITS), bloom(hot, "h", MOST_BITS), n // GROUP + 1), "lang string, g long, block binary")
    counted = keep(blocks.groupBy("lang", "g").applyInArrow(_counter(least), _COUNTED), "counted")
    pairs = counted.where("c IS NULL").drop("c")
    summed = pairs.where("partial").groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    triples = counted.where("c IS NOT NULL").drop("partial")
    return sizes, frequent, keep(pairs.where("NOT partial").drop("partial").unionByName(summed), "pairs"), triples


def _score(a: str, left: str, right: str):
    """floor(10^6 * a^2 / (l * r)) in exact decimals: a phrase occurs no more often than its parts."""
    return F.expr(f"(CAST({a} AS DECIMAL(16, 0)) * CAST({a} AS DECIMAL(16, 0)) * 1000000BD) DIV (CAST({left} AS DECIMAL(16, 0)) * CAST({right} AS DECIMAL(16, 0)))")


def collocations(docs: DataFrame, least: int = LEAST, most: int = 2000, share: int = 50) -> DataFrame:
    """text, lang of any rows -> lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases.

    A null lang counts as `und`, a null text as empty. Phrases of two and three words that occur `least` times within
    pieces are candidates. The lowest-scoring cut of a phrase gives l, r and score, of equal ones the first. A
    pair inside of a frequent triple that has at least `share` percent of its occurrences is left out. Ties of score
    and a go to the smaller phrase in byte order. Repeated rows count each; tables without words give no rows.
    """
    sizes, words, pairs, triples = phrases(docs, least)
    part = lambda k, f, w=None: words.select("lang", F.col("h").alias(k), F.col("f").alias(f), *([F.col("word").alias(w)] if w else []))
    inside = triples.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "n")
    inside = inside.groupBy("lang", "p.a", "p.b").agg(F.max("n").alias("_in"))
    two = pairs.join(inside, ["lang", "a", "b"], "left").where(f"_in IS NULL OR 100 * _in < {share} * n")
    two = two.join(part("a", "l", "_a"), ["lang", "a"]).join(part("b", "r", "_b"), ["lang", "b"])
    two = two.select("lang", F.concat_ws(" ", "_a", "_b").alias("phrase"), F.col("n").alias("a"), "l", "r", _score("n", "l", "r").alias("score"))
    head, tail = pairs.withColumnRenamed("n", "_ab"), pairs.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("_bc"))
    three = triples.join(head, ["lang", "a", "b"]).join(tail, ["lang", "b", "c"])
    three = three.join(part("a", "_fa", "_a"), ["lang", "a"]).join(part("b", "_fb", "_b"), ["lang", "b"]).join(part("c", "_fc", "_c"), ["lang", "c"])
    three = three.select("*", _score("n", "_fa", "_bc").alias("_s1"), _score("n", "_ab", "_fc").alias("_s2"))
    cut = lambda x, y: F.when(F.col("_s1") <= F.col("_s2"), F.col(x)).otherwise(F.col(y))
    three = three.select("lang", F.concat_ws(" ", "_a", "_b", "_c").alias("phrase"), F.col("n").alias("a"), cut("_fa", "_ab").alias("l"), cut("_bc", "_fc").alias("r"), cut("_s1", "_s2").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = two.unionByName(three).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    # The best of each part first, so that a language with many candidates isn't ranked by one task.
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_r") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
