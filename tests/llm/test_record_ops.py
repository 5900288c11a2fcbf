"""Top-k, mixing, substring dedup, counts, decontamination, near-dedup, token files: against brute force."""

from __future__ import annotations

import itertools
import random
import re
import time
import zlib
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import common, decontaminate, mixing, near_dedup, queries, substring_dedup, token_counts, token_output, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, key string"
PATH = public_tokenizers.path("word_bpe_49k.json")
LOW = {i: i + 32 for i in range(65, 91)}


def docs(spark, rows):
    """rows: (doc_id, text[, source]); the other columns clash with names that operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7, "x", 3, "k") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


# --- hashing -------------------------------------------------------------------------------------
@settings(deadline=None)
@given(st.text(alphabet="abAB \t\né ", max_size=60))
def test_word_hashes_follow_words(text):
    h, starts, ends = common.word_hashes(text.encode())
    raw = text.translate(LOW).encode()
    found = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
    assert found == re.findall(rb"[^\x20\x09-\x0D]+", raw)
    assert [common.hash_bytes(w) for w in found] == h.tolist()


def test_word_hashes_across_segments(monkeypatch):
    text = ("alpha beta gamma delta " * 50 + "x" * 300 + " end").encode()
    whole = common.word_hashes(text)[0]
    monkeypatch.setattr(common, "_SEGMENT", 64)
    monkeypatch.setattr(common, "_POWERS", [])
    assert (common.word_hashes(text)[0] == whole).all()


# --- top-k ---------------------------------------------------------------------------------------
def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(700, rows[0][1]), (701, rows[0][1]), (702, None), (703, [1.0, None] + [0.0] * 6), (704, [float("nan")] + [0.0] * 7), (705, [float("inf")] + [0.0] * 7), (None, rows[1][1]), (800, [1.0, 2.0]), (801, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df).collect()}
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = {}
    for q, v in usable:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
            expected |= {(q, n): (i, -x) for n, (x, i) in enumerate(s[:10], 1)}
    assert got == expected
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 1")).count() == 0


def test_topk_repeated_and_unusable_queries(spark):
    rows = [(100, None), (100, [1.0, 2.0]), (100, [-1.0, 0.5]), (200, [float("nan"), 1.0]), (1, [0.25, 0.25]), (2, [1.0, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect())
    m = 1024 * 1024
    assert got == sorted([(100, 1, 2, m), (100, 2, 2, m), (100, 3, 1, m * 3 // 4), (100, 1, 1, -m // 8), (100, 2, 2, -m), (100, 3, 2, -m)])
    assert topk.top_k(df.where("vec_id = 200 OR vec_id < 100")).count() == 0  # a query, but none that is usable


def test_topk_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(900)], "vec_id long, embedding array<float>").repartition(3)
    whole = sorted(map(tuple, topk.top_k(df, 10).collect()))
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "HELD", 50)
    assert sorted(map(tuple, topk.top_k(df, 10).collect())) == whole and len(whole) == 900


def test_topk_large_values_are_exact():
    c, q = np.array([[2.0**40, 3.0], [2.0**40, 4.0]]), np.array([2.0**20, 1.0])
    assert topk.scores(c, q).tolist() == [2**60 + 3, 2**60 + 4]


# --- mixing --------------------------------------------------------------------------------------
def test_targets_stop_at_twice_the_source():
    t = mixing.targets({"a": 100, "b": 1000, None: 0, "c": 10})
    assert t[None] == 0 and t["a"] == 200 and t["c"] == 20 and abs(float(sum(t.values())) - 1665) < 1e-9


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "b"), (402, "x " * 5000, "c"), (1, "repeat of an id", "a"), (2, rows[2][1], rows[2][2]), (None, "no id", "a")]
    df = docs(spark, rows)
    out = mixing.mix(df).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    by = out.groupby("target").agg(taken=("taken", "sum"), source=("source_size", "first"))
    assert (abs(by.taken - by.index) <= 1).all() and (by.taken <= 2 * by.source).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert out[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    assert mixing.mix(df.limit(0)).count() == 0


def brute_mix(rows, block):
    """{(doc_id, nth): (pieces by position)} of rows (doc_id, nth, source, size) by walking slot after slot."""
    sizes = {}
    for _, _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    goal = mixing.targets(sizes)
    key = lambda s: "n" if s is None else "s" + s
    take = {s: min(round(goal[s]), 2 * sizes[s]) for s in sizes}
    slots = {s: -(-take[s] // block) for s in sizes if take[s]}
    names = sorted(slots, key=key)
    total, edges = sum(slots.values()), []
    for s in names[:-1]:
        edges.append(((edges[-1][0] if edges else 0) + slots[s], s))
    order, done, i = [], dict.fromkeys(names, 0), 0
    while any(done[s] < slots[s] for s in names):
        point = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
        s = names[sum(point >= (e << 64) // total for e, _ in edges)]
        if done[s] < slots[s]:
            order.append((i, s, done[s]))
            done[s] += 1
        i += 1
    return goal, take, order


def test_mix_follows_the_schedule(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["a", "a", "b", None])) for i in range(150)]
    df = docs(spark, rows)
    base = mixing._base(df)
    mixed, sizes, goal = mixing.pieces(base, 64)
    found = mixed.collect()
    source = {r.doc_id: r.source for r in base.collect()}
    expected_goal, take, order = brute_mix([(r.doc_id, r.nth, r.source, r["size"]) for r in base.collect()], 64)
    assert goal == expected_goal
    by_slot = {}
    for r in found:
        by_slot.setdefault((r.position, source[r.doc_id]), []).append(r.words)
    assert {k: sum(v) for k, v in by_slot.items()} == {(p, s): min(64, take[s] - 64 * n) for p, s, n in order}
    out = {r.doc_id: r for r in mixing.mix(df).collect()}  # blocks of the usual size
    assert all((r.first_position is None) == (r.taken == 0) == (r.n_pieces == 0) for r in out.values())


def test_mixed_documents_keep_their_columns(spark):
    rows = [(i, "some words of text " * (i % 5), "ab"[i % 2], i) for i in range(60)] + [(None, "no id", "a", -1), (3, "again", "b", 99), (3, "again", "b", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, nth int")
    out = mixing.mixed_documents(df)
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and len(got) > 60
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r)
    mine = {}
    for i, t, s, n in got:
        assert any(t == x[1] or x[1].startswith(t) for x in texts[i] if (s, n) == x[2:])
        mine[i] = mine.get(i, 0) + len(t.split())
    assert mine == {i: n for i, n in taken.items() if n}
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_stretches_of_the_mix_are_near_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 5000)
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{j}" for j in range(rng.randint(1, 60))), rng.choice("aaabc")) for i in range(3000)]
    df = docs(spark, rows)
    kept = common.keep(mixing.mixed_documents(df), "mixed")
    placed = kept.select("source", "text", "n_chars", "_metadata.file_path", "_metadata.row_index").toPandas().sort_values(["file_path", "row_index"])
    assert placed.file_path.nunique() > 5
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    goal = {s: float(t) for s, t in mixing.targets(sizes).items()}
    share, seen, n = {s: t / sum(goal.values()) for s, t in goal.items()}, dict.fromkeys("abc", 0), 0
    for s, t in zip(placed.source, placed.text, strict=True):
        seen[s] += len(t.split())
        n += len(t.split())
        assert all(abs(seen[x] - share[x] * n) < 4 * mixing.BLOCK_WORDS + 120 for x in "abc")
    assert all(abs(seen[x] - goal[x]) <= 1 for x in "abc")


@pytest.mark.parametrize("text, n, expected", [("a b c", 2, "a b"), ("  a\tb  c ", 2, "  a\tb"), ("a b", 2, "a b"), ("a b ", 5, "a b "), ("x", 1, "x"), ("é\u00a0ü b", 1, "é\u00a0ü")])
def test_first_words(spark, text, n, expected):
    df = spark.createDataFrame([(text, n)], "t string, n int")
    assert df.select(mixing.first_words(F.col("t"), F.col("n"))).first()[0] == expected


def test_schedule_is_balanced_everywhere(spark):
    slots = {"a": 300, "b": 100, "c": 200, "d": 1}
    got = sorted((r.position, r.key, r["rank"]) for r in mixing.schedule(spark, slots).collect())
    assert {k: [r for _, key, r in got if key == k] for k in slots} == {k: list(range(n)) for k, n in slots.items()}
    head = [k for _, k, _ in got[:120]]
    assert abs(head.count("a") - 60) <= 4 and abs(head.count("c") - 40) <= 4


# --- substring dedup -----------------------------------------------------------------------------
def test_repeated_passages(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    shared = [noise(60) for _ in range(20)]
    rows = [(i, noise(40)) for i in range(40)]
    rows += [(100 + i, noise(33) + " " + p + " " + noise(21)) for i, p in enumerate(shared)] + [(200 + i, noise(5) + "\n" + p.upper()) for i, p in enumerate(shared)]
    rows += [(300, None), (301, ""), (302, "one"), (303, "same " * 3000), (None, shared[0]), (100, rows[40][1])]
    out = substring_dedup.repeated_passages(docs(spark, rows)).toPandas()
    assert set(out.doc_id) == {*range(100, 120), *range(200, 220)}
    for r in out.itertuples():
        text = words(dict(rows)[r.doc_id])
        assert " ".join(text[r.first_word : r.end_word]) in shared[r.doc_id % 100] and r.is_first == (r.doc_id < 200)
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_runs_occur_elsewhere_as_a_whole(spark):
    """Chunks that other documents have one by one, in other places, make no passage."""
    rng = random.Random(3)
    text = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    first, n = substring_dedup.chunks(common.word_hashes(" ".join(text).encode())[0])
    noise = lambda i: " ".join(f"n{i}x{j}" for j in range(30))
    rows = [(0, " ".join(text))] + [(i + 1, noise(2 * i) + " " + " ".join(text[max(0, a - 5) : a + m]) + " " + noise(2 * i + 1)) for i, (a, m) in enumerate(zip(first.tolist(), n.tolist(), strict=True)) if m < 10]
    assert len(rows) > 6 and substring_dedup.repeated_passages(docs(spark, rows)).count() == 0
    both = substring_dedup.repeated_passages(docs(spark, [(1, " ".join(text)), (2, " ".join(text))])).collect()
    assert sorted((r.doc_id, r.first_word, r.end_word, r.n_words, r.owner_id, r.is_first) for r in both) == [(1, 0, 60, 60, 1, True), (2, 0, 60, 60, 1, False)]


def test_windows_cover_runs():
    for size, least, values in itertools.product((40, 300), (5, 16, 36), (2**63, 2, 1)):
        h = np.random.default_rng(size).integers(0, values, size, dtype=np.uint64)
        first, n, _, _ = substring_dedup.windows(h, least)
        end = np.maximum.accumulate(first + n)
        assert first[0] == 0 and end[-1] == size and (first[1:] < end[:-1]).all() and (n >= least).all()
        assert n.max() < least + substring_dedup.SPAN + substring_dedup.WINDOW


@settings(deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40))
def test_cuts_are_least_of_neighbours(values):
    k = substring_dedup.SPAN
    last_least = {a + k - 1 - min(range(k), key=lambda i: values[a : a + k][::-1][i]) for a in range(len(values) - k + 1)}
    assert set(np.flatnonzero(substring_dedup._cuts(np.array(values, np.uint64))).tolist()) == last_least


def test_chunks_resist_insertions():
    h = np.random.default_rng(0).integers(0, 2**63, 400, dtype=np.uint64)
    words = lambda h: {tuple(h[f : f + n]) for f, n in zip(*substring_dedup.chunks(h), strict=True)}
    assert len(words(h) - words(np.r_[h[:100], h[7:10], h[100:]])) <= 4
    first, n = substring_dedup.chunks(h)
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == 400


def _common_runs(a, b):
    """Length of the longest run of words that both texts hold, by brute force."""
    best, row = 0, {}
    for x in a:
        now = {}
        for j, y in enumerate(b):
            if x == y:
                now[j] = row.get(j - 1, 0) + 1
                best = max(best, now[j])
        row = now
    return best


def test_passages_against_brute_force(spark):
    """Every passage of SPAN words a side above the least length is found, most of the shorter ones, and none below it."""
    rng = random.Random(31)
    noise = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    rows = [noise(rng.randint(30, 120)) for _ in range(20)]
    for n in (10, 13, 15, 15, 16, 16, 16, 18, 20, 20, 20, 22, 22, 22, 22, 25, 30, 30, 35, 50, 51, 80):
        passage = noise(n)
        rows += [noise(20) + passage + noise(15), noise(3) + passage + noise(40), noise(60) + passage]
    df = docs(spark, [(i, " ".join(x)) for i, x in enumerate(rows)])
    longest = [max(_common_runs(x, y) for j, y in enumerate(rows) if j != i) for i, x in enumerate(rows)]
    for least in (16, 10):
        got = {r.doc_id for r in substring_dedup.repeated_passages(df, least).collect()}
        assert {i for i, n in enumerate(longest) if n >= least + 2 * substring_dedup.SPAN} <= got <= {i for i, n in enumerate(longest) if n >= least}
    with pytest.raises(ValueError, match="5 or more"):
        substring_dedup.repeated_passages(df, 4)


def test_recall_of_passages_by_length():
    """The share of passages that have a window in common with another text around them, by their length."""
    rng, found = np.random.default_rng(7), {}
    noise = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    for n in (15, 16, 18, 20, 22, 30, 50):
        hits = 0
        for _ in range(300):
            p = noise(n)
            a, b = (substring_dedup.windows(np.r_[noise(rng.integers(0, 40)), p, noise(rng.integers(0, 40))], 16)[2] for _ in range(2))
            hits += len(np.intersect1d(a, b)) > 0
        found[n] = hits / 300
    assert found[15] == 0 and 0 < found[16] < found[18] < found[20] <= 1 and found[22] == found[30] == found[50] == 1
    assert found[16] > 0.04 and found[18] > 0.45 and found[20] > 0.8, found  # measured: 0.09, 0.57, 0.90


def test_without_passages(spark):
    rng = random.Random(17)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    p, q = noise(70), noise(80)
    rows = [(1, noise(30) + " " + p), (2, noise(9) + "\n" + p + "\n" + noise(12) + " " + q), (3, q + " " + noise(20)), (4, noise(50)), (5, None), (None, p), (6, p + " " + noise(5) + " " + p)]
    df = docs(spark, rows)
    out = {r.doc_id: r.text for r in substring_dedup.without_passages(df).collect()}
    texts = dict(rows)
    assert out[1] == texts[1] and out[4] == texts[4] and out[5] is None and out[None] == p
    assert len(words(out[2])) < 9 + 12 + 80 + 12 and q in out[2] and len(words(out[3])) < 20 + 12 and len(words(out[6])) < 5 + 24
    assert substring_dedup.without_passages(df).columns == df.columns and substring_dedup.without_passages(df.limit(0)).count() == 0
    alone = docs(spark, [(7, p + " " + noise(8) + " " + p)])
    assert substring_dedup.repeated_passages(alone).count() == 0
    assert sorted(r.is_first for r in substring_dedup.repeated_passages(alone, within=True).collect()) == [False, True]


# --- counts --------------------------------------------------------------------------------------
def test_rollup_is_idempotent(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    of = lambda rows: token_counts.counted(docs(spark, rows), "words-1", "runs-2")
    df = of([(1, "a b c", "s"), (2, None, "s"), (3, "x.y", None), (3, "x.y", None)])
    assert rollup.commit("b1", token_counts.changes(df, 1, "words-1"))
    assert not rollup.commit("b1", token_counts.changes(df, 1, "words-1"))
    assert rollup.commit("b2", token_counts.revision(df.where("doc_id = 1"), of([(1, "a", "s")]), "words-1"))
    (tmp_path / "r" / ".b3-0").mkdir()  # an interrupted commit
    got = sorted((str(r.source), r.n_docs, r.n_tokens) for r in token_counts.Rollup(spark, f"file://{tmp_path}/r").totals().collect())
    assert got == [("None", 2, 2), ("s", 2, 1)]
    rollup.commit("b4", token_counts.changes(of([(3, "x.y", None), (3, "x.y", None)]), -1, "words-1"))
    assert [r.source for r in rollup.totals().collect()] == ["s"]
    assert {r.n_tokens for r in token_counts.changes(of([(5, "x.y", "s")]), 1, "words-1", "runs-2").collect()} == {1, 3}
    for bad in ("../x", "base-1", ""):
        with pytest.raises(ValueError):
            rollup.commit(bad, token_counts.changes(df, 1, "words-1"))
    before = sorted(map(str, rollup.totals().collect()))
    assert rollup.batches() == ["b1", "b2", "b4"] and rollup.compact() and rollup.batches() == [] and not rollup.compact()
    assert sorted(map(str, rollup.totals().collect())) == before
    assert not rollup.commit("b2", token_counts.changes(df, 1, "words-1")) and rollup.commit("b5", token_counts.changes(of([(9, "q r", "s")]), 1, "words-1"))
    assert rollup.compact() and sorted((r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()) == [("s", 3, 3)]
    assert not rollup._put("base-000000001", lambda path: df.select("doc_id").write.parquet(path)) and sorted(p.name for p in (tmp_path / "r").iterdir() if p.name[0] != ".") == ["base-000000001"]


# --- decontamination -----------------------------------------------------------------------------
def test_a_phrase_of_many_items_makes_no_pairs(spark):
    """All documents and items share words; what overlaps besides is found, also with nothing in common but runs around
    the shared words, and items that are shared as wholes."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    phrase = "choose one of the following answers please now".split()
    items = [[word() for _ in range(12)] + phrase[: 6 + i % 3] + [word() for _ in range(12)] for i in range(40)]
    items += [["same", *phrase, "whole", "item", "for", "all", "of", "these", "and", "no", "other", "one"]] * 12
    texts = [[word() for _ in range(30)] + phrase + [word() for _ in range(30)] for _ in range(120)]
    for d in range(0, 60, 3):  # near copies of a stretch around the phrase, with a substitution now and then
        stretch = items[d % 40][6:24]
        texts[d][10:10] = [w if rng.random() < 0.9 else word() for w in stretch]
    texts[1][5:5] = items[-1]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.matching_words for r in decontaminate.contamination(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), bench).collect()}
    hashed = lambda t: common.word_hashes(" ".join(t).encode())[0]
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = hashed(text), hashed(item)
            best = decontaminate.overlap(a, b, np.arange(1 - len(b), len(a)))
            if best:
                want[d, i] = best[0]
    assert found == want and len(want) > 25


def test_decontamination(spark):
    rng = random.Random(2)
    w = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    items = [w(30) for _ in range(6)] + [w(8), w(3)]
    edited = [x if i % 6 else "changed" for i, x in enumerate(items[1])]
    inserted = items[2][:15] + ["more"] + items[2][15:]
    bench = spark.createDataFrame([(i, " ".join(x), "z") for i, x in enumerate(items)] + [(90, None, "z"), (91, "", "z")], "item_id long, text string, doc_id string")
    rows = [(1, " ".join(w(20) + items[0] + w(9))), (2, " ".join(w(5) + edited)), (3, " ".join(inserted)), (4, " ".join(items[3][:10] + w(40))), (5, " ".join(w(100))), (6, " ".join(items[6]).upper()), (7, " ".join(items[7])), (8, None), (9, ""), (10, " ".join(w(20_000) + items[4])), (10, " ".join(items[4])), (None, " ".join(items[5]))]
    df = docs(spark, rows)
    got = sorted((r.doc_id or 0, r.item_id, r.matching_words) for r in decontaminate.contamination(df, bench).collect())
    assert got == [(0, 5, 30), (1, 0, 30), (2, 1, 25), (3, 2, 15), (6, 6, 8), (7, 7, 3), (10, 4, 30), (10, 4, 30)]
    kept = decontaminate.clean_only(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 8, 9]
    assert decontaminate.clean_only(df, bench.limit(0)).count() == len(rows) and decontaminate.clean_only(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.contamination(df.limit(0), bench).count() == 0


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 15, 24):
        for _ in range(60):
            same = rng.random(n) < 0.8
            runs = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if 5 * same[i:j].sum() >= 4 * (j - i)]
            matched, start, end = decontaminate.best_run(same)
            assert matched == max([same[i:j].sum() for i, j in runs], default=0)
            assert not matched or ((start, end) in runs and same[start:end].sum() == matched)


def brute_overlap(text, item):
    """Matches of the best run of at least 80 % over all ways to lay an item over a text; 0 if too few."""
    need, most = min(12, -(-4 * len(item) // 5)), 0
    if len(item) < 5:
        return len(item) if text == item else 0
    for shift in range(1 - len(item), len(text)):
        same = [0 <= shift + i < len(text) and text[shift + i] == w for i, w in enumerate(item)]
        if sum(same) <= max(most, need - 1):
            continue
        sums = np.r_[0, np.cumsum(same)]
        most = max([most, *(int(sums[j] - sums[i]) for i in range(len(item)) for j in range(i + 1, len(item) + 1) if 5 * (sums[j] - sums[i]) >= 4 * (j - i))])
    return most if most >= need else 0


def test_every_item_at_80_percent_is_found(spark):
    items = {n: [f"i{n}w{i}" for i in range(n)] for n in range(1, 21)}
    rows, expected = [], {}
    for n, item in items.items():
        for changed in [c for k in range(4) for c in itertools.combinations(range(n), k)]:
            text = ["x" if i in changed else w for i, w in enumerate(item)]
            text = text if n < 5 else ["a", "b", "c", *text, "d"]
            same = np.r_[0, np.cumsum([i not in changed for i in range(n)])]
            most = max((int(same[j] - same[i]) for i in range(n) for j in range(i + 1, n + 1) if 5 * (same[j] - same[i]) >= 4 * (j - i)), default=0)
            if n < 5:
                most = 0 if changed else n
            if most >= min(12, -(-4 * n // 5)):
                expected[len(rows)] = (n, most)
            rows.append((len(rows), " ".join(text)))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.matching_words) for r in decontaminate.contamination(docs(spark, rows), bench).collect()}
    assert got == expected


def test_repetitive_texts_equal_brute_force(spark):
    rng = random.Random(21)
    few = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    items = [few(n, k) for n in (3, 5, 8, 14, 25) for k in (1, 2, 4)] + [["ha"] * 20, ["ha", "ho"] * 9]
    texts = [few(n, k) for n in (0, 1, 3, 6, 20, 60) for k in (1, 2, 4)] + [["ha"] * 50, ["ha", "ho"] * 30, ["ha"] * 10 + ["x"] + ["ha"] * 10]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matching_words for r in decontaminate.contamination(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), bench).collect()}
    expected = {(i, j): n for i, t in enumerate(texts) for j, x in enumerate(items) if (n := brute_overlap(t, x))}
    # Of texts of few words a run may lack a mask's worth of neighbours: what is found is right, and nothing of 15 words is missed.
    assert got.items() <= expected.items() and all(k in got for k, n in expected.items() if len(items[k[1]]) >= 15 or len(items[k[1]]) < 5)


def test_one_repeated_word_is_quick():
    words = lambda n: common.word_hashes(("ha " * n).encode())[0]
    began = time.perf_counter()
    for n, m in ((2000, 1000), (100_000, 1500)):
        a, b = words(n), words(m)
        lists = [(p, q) for mask in decontaminate.MASKS for p, q in [(np.arange(n - len(mask) + 1), np.arange(m - len(mask) + 1))]]
        ways = decontaminate.shifts(n, m, lists)
        assert decontaminate.overlap(a, b, ways) == (m, 0, m)
    assert time.perf_counter() - began < 5


def test_filter_of_seeds_has_all(spark):
    h = np.random.default_rng(3).integers(0, 2**64, 500, dtype=np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "hash long")
    for row, s in zip(common.filter_bits(h, 1 << 20), common._SPREAD, strict=True):
        got = frame.select(F.shiftrightunsigned(common._times(F.col("hash"), s), 44).alias("p")).collect()
        assert [r.p for r in got] == row.tolist()
    table = common.bloom(frame, "hash", 1 << 20)
    others = np.random.default_rng(4).integers(0, 2**64, 5000, dtype=np.uint64)
    assert len(common.passing(h, table)) == 500 and len(common.passing(others, table)) < 100


# --- near-dedup ----------------------------------------------------------------------------------
def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {(i, len(s), find(i) if s else i) for i, s in sets}


def near_rows(seed, n_groups=12, copies=9):
    rng = random.Random(seed)
    w = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    passage, rows = w(45), []
    for _ in range(n_groups):
        base = w(rng.randint(5, 120))
        for c in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, c)):
                t[rng.randrange(len(t))] = w(1)[0]
            rows.append(" ".join(t))
    rows += [" ".join(passage + w(rng.randint(3, 12))) for _ in range(90)]  # around the threshold by a shared passage
    rows += ["", "  \t", "one", "ONE", "one two", "One  two", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k, seed", [(4, 1), (5, 2)])
def test_near_duplicates_equal_brute_force(spark, k, seed):
    rows = near_rows(seed)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), k, 80).collect()}
    assert got == brute_components(rows, k, 80)


def test_common_elements_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "COMMON", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = near_rows(5)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), 4, 80).collect()}
    assert got == brute_components(rows, 4, 80)


def test_settled_links_the_smallest_head(spark, monkeypatch):
    """Two heads whose common parts differ, and random sets: everything that brute force connects."""
    monkeypatch.setattr(near_dedup, "COMMON", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rng = random.Random(6)
    sets = {1: {*range(20), 50, 90}, 2: {*range(20), 51}, 3: {50, 51, *range(300, 321)}}
    for node in range(4, 44):  # variants of three passages with tails of their own
        passage = [*range(1000 + 20 * (node % 3), 1020 + 20 * (node % 3))]
        sets[node] = {*rng.sample(passage, rng.randint(17, 20)), *range(100 * node + 5000, 100 * node + 5000 + rng.randint(0, 4))}
    rest = spark.createDataFrame([(i, i) for i in sets], "node long, label long")
    (links,) = near_dedup._settled(rest, spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, elements array<long>"), 80)
    pairs = {(r.a, r.b) for r in links.collect()}
    passes = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}

    def roots(edges):
        root = {i: i for i in sets}
        for _ in sets:
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert (1, 2) in passes and pairs <= passes and roots(pairs) == roots(passes)


def test_near_duplicate_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (6, None), (7, ""), (8, "x y z u v w"), (None, "a b c d e f"), (9, "A b C d e f"), (8, "other text of this id")]
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows), 4, 80).collect())
    assert out == [(0, 3, 0, True), (5, 3, 5, True), (5, 3, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 2, 8, True), (8, 3, 8, True), (9, 3, 5, False)]
    one = near_dedup.one_of_each(docs(spark, rows))
    kept = sorted((r.doc_id or 0, r.text or "") for r in one.collect())
    assert kept == [(0, "a b c d e f"), (5, "a b c d e f"), (6, ""), (7, ""), (8, "other text of this id"), (8, "x y z u v w")]
    assert one.columns == docs(spark, rows).columns and near_dedup.one_of_each(docs(spark, [])).count() == 0
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_all_texts_of_a_repeated_id_are_compared(spark):
    rows = near_rows(7, n_groups=5, copies=6)
    rows = [(i % 70, t) for i, t in rows]  # ids repeat with other texts
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), 4, 80).collect()}
    root = {i: i for i, _ in rows}
    nodes = [(j, t) for j, (_, t) in enumerate(rows)]
    groups = [(rows[j][0], rows[c][0]) for j, n, c in brute_components(nodes, 4, 80) if n]
    for _ in root:
        for a, b in groups:
            root[a] = root[b] = min(root[a], root[b])
    linked = {i for (i, t) in rows if words(t)}
    assert {(i, c) for i, c in got if i in linked and c != i} == {(i, root[i]) for i in linked if root[i] != i}
    one = near_dedup.one_of_each(docs(spark, rows), 4, 80)
    assert one.count() == len({c for _, n, c in brute_components(nodes, 4, 80) if n}) + len({(i, t) for i, t in rows if not words(t)})


def test_overlap_in_slices(monkeypatch):
    monkeypatch.setattr(near_dedup, "VOCABULARY", 7)
    rng = np.random.default_rng(4)
    sets = [rng.choice(60, rng.integers(0, 40), replace=False) for _ in range(12)]
    whose, flat = np.repeat(np.arange(12), [len(s) for s in sets]), np.concatenate(sets)
    out = near_dedup._overlap(whose, flat, 12, whose, flat, 12)
    assert out.tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


def test_min_max_estimates_jaccard():
    rng = np.random.default_rng(0)
    x = common.mix(rng.integers(0, 2**63, 1500, dtype=np.uint64))
    a, b = near_dedup.min_max(x[:1000], 256), near_dedup.min_max(x[500:], 256)
    assert abs((a == b).mean() - 1 / 3) < 0.08


# --- token files ---------------------------------------------------------------------------------
@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=6))
def test_codes_round_trip(lists):
    counts, values = np.array([len(x) for x in lists], np.int64), np.array([v for x in lists for v in x], np.uint32)
    control, data = token_output.pack(values, counts)
    back = token_output.unpack(np.frombuffer(b"".join(control), np.uint8), np.frombuffer(b"".join(data), np.uint8), counts)
    assert back.tolist() == values.tolist()


TOKENIZER = Tokenizer.from_file(PATH)


@settings(deadline=None)
@given(st.text(alphabet="abcZÉéßΣς'sd 0¼12.,|\n ́\x1c\x1f<>漢", max_size=40))
def test_encoder_equals_library(text):
    assert np.frombuffer(token_output.encoder(PATH).encode(text), "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encoder_parts_and_specials(monkeypatch):
    monkeypatch.setattr(token_output, "PART", 16)
    enc = token_output.encoder(PATH)
    for text in ("it's a longer text, with We've and don't; 'tis. " * 9, "a" * 100 + " b", "x <|endoftext|> y", "  lead and trail  "):
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_token_files(spark):
    rows = [(9, "The end."), (3, None), (4, ""), (-2, "Ünïcode text"), (7, "long words " * 20_000), (None, "no id"), (4, "same id"), (4, ""), (-(2**63), "least id"), (2**63 - 1, "greatest id"), (2**62 + 1, "odd")]
    out = token_output.token_files(docs(spark, rows), PATH).collect()
    expected, start = [], 0
    of = lambda t: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1]
    tie = lambda ids: zlib.crc32(np.array(ids, "<u2").tobytes())
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(of(r[1])))):
        ids = of(t)
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: (r[1], r[2])) == expected
    assert token_output.token_files(docs(spark, []), PATH).count() == 0
    assert token_output.token_files(docs(spark, []), PATH, as_read=True).count() == 0


def test_token_files_keep_the_order_of_files(spark, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_ROWS", 2)
    rows = [(i * 7 % 11, f"text number {i}") for i in range(11)] + [(None, None)]
    stored = common.keep(docs(spark, rows).coalesce(1).repartitionByRange(3, "text").sortWithinPartitions(F.desc("text")), "stored")
    placed = stored.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").collect()
    placed.sort(key=lambda r: (r.file_path, r.row_index))
    out = sorted(token_output.token_files(stored, PATH, as_read=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [r.doc_id for r in placed] and [r.doc_id for r in out] != sorted(r.doc_id or 0 for r in out)
    start = 0
    for r, p in zip(out, placed, strict=True):
        ids = [*TOKENIZER.encode(p.text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.token_files(docs(spark, rows), PATH, as_read=True).count() == len(rows)


# --- the pipeline --------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("test tables are missing")
    data, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, data = data, stage(spark, data, sf)
        data = common.keep(data, name)
        if name != "token_output":
            assert data.columns == before.columns
        kept[name] = [r.doc_id for r in data.collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    comp = brute_components([(i, texts[i]) for i in kept["toxicity"]], 5, 80)
    assert set(kept["near_dedup"]) == {c for _, _, c in comp} and len(set(kept["near_dedup"])) == len(kept["near_dedup"])
    assert set(kept["decontamination"]) <= set(kept["near_dedup"]) and max(map(kept["mixing"].count, kept["mixing"])) <= 2
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {i for i in kept["near_dedup"] for x in items if len(set(x) & set(words(texts[i]))) >= min(10, len(set(x))) and brute_overlap(words(texts[i]), x)}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == bad and bad
    scores = {r.doc_id: r.score for r in queries.op3_subword_toxicity(spark, sf).collect()}
    assert set(kept["toxicity"]) == {i for i in texts if scores[i] < 0.5}
    out = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin(kept["mixing"]))
    assert sorted(kept["token_output"]) == sorted(kept["mixing"]) and set(kept["mixing"]) == {r.doc_id for r in out.collect()}


def test_stages_on_odd_tables(spark):
    """Nulls, repeated ids with other texts, empty and long texts, columns whose names operators use."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("test tables are missing")
    rows = [(1, None), (1, "one text of this id"), (1, "quite another text of this id"), (1, "one text of this id"), (None, "no id here"), (2, ""), (3, "x y " * 5000), (4, None), (5, "  ")]
    odd = docs(spark, rows)
    expected = {"toxicity": rows, "near_dedup": list(set(rows)), "decontamination": rows, "mixing": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and stage(spark, odd.limit(0), sf).count() == 0
        found = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
        if expected[name] is not None:
            assert found == sorted((i or 0, t or "") for i, t in expected[name]), name
        else:
            assert {i for i, _ in found} == {i or 0 for i, t in rows if words(t)} and all(any((i or 0, t) == (x, (y or "")[: len(t)]) for x, y in [(r[0] or 0, r[1]) for r in rows]) for i, t in found)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, sf).count() == len(rows) and last(spark, odd.limit(0), sf).count() == 0


def test_mix_sizes_and_targets(spark):
    """The columns that don't follow from the shuffle: sizes by SQL, targets by pouring word after word."""
    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("test tables are missing")
    sql = r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) OVER (PARTITION BY source) AS source_size, source FROM '" + str(sf) + "/documents.parquet'"
    expected = duckdb.sql(sql).fetchall()
    sizes = {s: int(n) for _, _, n, s in expected}
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, float(10 * sum(sizes.values()))
    for _ in range(200):  # the level of the water, by halving
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], 2 * sizes[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, mid)
    goal = {s: min(high * weight[s], 2 * sizes[s]) for s in names}
    got = {r.doc_id: (r["size"], r.source_size, r.target) for r in queries.op5_source_mixing(spark, str(sf)).collect()}
    assert len(got) == len(expected)
    for i, n, total, s in expected:
        assert got[i][:2] == (n, int(total)) and abs(got[i][2] - goal[s]) < 1e-3


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_queries_side_by_side(spark):
    """Each thread owns its tables: none releases what another still reads."""
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(400)], k=40))
    df = docs(spark, [(i, text(), f"s{i % 3}") for i in range(60)])
    bench = spark.createDataFrame([(i, text()) for i in range(5)], "item_id long, text string")
    jobs = [lambda: near_dedup.near_duplicates(df, k=4, percent=80).count(), lambda: mixing.mixed_documents(df).count(), lambda: decontaminate.clean_only(df, bench).count()]
    alone = [job() for job in jobs]
    for _ in range(2):
        with ThreadPoolExecutor(len(jobs)) as pool:
            assert [f.result() for f in [pool.submit(job) for job in jobs]] == alone
