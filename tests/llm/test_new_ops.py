"""Exact dedup, collocations and whitening: against brute force, with hot groups, nulls, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import collocations, exact_dedup, whitening

DOCS = "doc_id long, text string, lang string, key long, h long, n long, top string, bucket int, part int"


def docs(spark, rows):
    """rows: (doc_id, text[, lang]); the other columns clash with names that operators use."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", 1, 2, 3, "t", 4, 5) for r in rows], DOCS)


# --- exact dedup ---------------------------------------------------------------------------------
def brute_classes(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out, left = [], {}
    for doc_id, text in rows:
        members = groups[text or ""]
        keep = max((m for m in members if m is not None), default=None)
        first = left.setdefault(text or "", True) and doc_id == keep
        if first:
            left[text or ""] = False
        out.append((doc_id, keep, len(members), first, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found_classes(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize(("table_bytes", "many"), [(32 << 20, 1024), (300, 1024), (300, 2), (1, 3)])
def test_exact_dedup_equals_brute_force(spark, table_bytes, many):
    rng = random.Random(5)
    texts = ["", None, "a", "a ", "A", "é" * 40, "x" * 5000, *(f"text {i} " * (i % 7) for i in range(40))]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, "hot") for i in range(150)] + [(None, "none"), (None, "none"), (None, "a"), (7, "again"), (7, "again"), (3, "again")]
    rng.shuffle(rows)
    df = docs(spark, rows).repartition(9)
    assert found_classes(exact_dedup.membership(df, table_bytes, many)) == brute_classes(rows)


def test_exact_dedup_of_empty_tables(spark):
    none = docs(spark, [(1, "x")]).where("false")
    assert exact_dedup.membership(none).count() == 0 and exact_dedup.without_copies(none).count() == 0


def test_without_copies_keeps_columns_and_one_row(spark):
    rows = [(1, "x"), (2, "x"), (2, "x"), (3, None), (None, ""), (None, "z"), (None, "z")]
    kept = exact_dedup.without_copies(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "x"), (3, None), (None, "z")], key=str)


@settings(deadline=None)
@given(st.lists(st.binary(max_size=3), max_size=120))
def test_content_table_compares_contents(contents):
    table, seen = exact_dedup.ContentTable(1 << 20), {}
    for c in contents:
        h = len(c)  # many contents share a hash: the content decides
        entry, slot = table.find(h, c)
        assert entry == seen.get(c, -1)
        if entry < 0:
            seen[c] = table.add(h, c, slot)
    assert [table.contents[e] for e in seen.values()] == list(seen)


# --- collocations --------------------------------------------------------------------------------
LOW = {i: i + 32 for i in range(65, 91)}


def brute_collocations(rows, least, most, share=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in good.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inside[q] = max(inside[q], a)
        scored = []
        for p, a in good.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "é", "ça", "x\x01y", "\x00", *(f"w{i}" for i in range(30))]
    text = lambda: "".join(rng.choices(words, [30, 5, 9, 4, 4, 4, 3, 3, 2, 2] + [1] * 30)[0] + rng.choice([" "] * 9 + ["\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?"]) for _ in range(rng.randrange(40)))
    rows = [(text(), rng.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("new york city " * 30, "en"), ("a a a a a a a a a a a a a a", "de"), (" \t\n", "xx"), ("one", "yy")]


@pytest.mark.parametrize("bound", [collocations.GROUP, 40])
def test_collocations_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(collocations, "GROUP", bound)  # a low one makes the frequent words hot and the groups many
    rows = corpus()
    df = docs(spark, [(i, *r) for i, r in enumerate(rows)]).repartition(5)
    found = collocations.collocations(df, least=5, most=60)
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_collocations(rows, 5, 60)


def test_collocations_of_little_text(spark):
    assert collocations.collocations(docs(spark, [(1, "x")]).where("false")).count() == 0
    assert collocations.collocations(docs(spark, [(1, None), (2, "one two")])).count() == 0


def test_words_under_every_seed_are_the_same():
    text = "Ab, cd\te. \x01f é:g\r\nh".encode()
    plain, h, start, end, piece = collocations.words_of(text)
    other = collocations.words_of(text, 4)
    assert [plain[s:e] for s, e in zip(start, end, strict=True)] == [b"ab", b"cd", b"e", b"\x01f", "é".encode(), b"g", b"h"]
    assert (start == other[2]).all() and (piece == other[4]).all() and not (h == other[1]).any()


@settings(deadline=None, max_examples=50)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.integers(0, 3), st.integers(1, 5)), min_size=1, max_size=60))
def test_prefix_counts(rows):
    (pairs, n), (triples, m) = collocations.prefix_counts(np.array([r[:3] for r in rows], np.uint64), np.array([r[3] for r in rows]))
    want = Counter()
    for a, b, c, k in rows:
        want[a, b] += k
        if c:
            want[a, b, c] += k
    assert {tuple(map(int, p)): int(k) for p, k in [*zip(pairs, n, strict=True), *zip(triples, m, strict=True)]} == dict(want)


# --- whitening -----------------------------------------------------------------------------------
EMBEDDINGS = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "c") for i, v in rows], EMBEDDINGS)


def brute_whitening(rows, k=8):
    x = [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]) for i, v in rows]
    m, n = np.array([v for _, v in x], object), len(x)
    sums = m.sum(0)
    deviation = [int(((n * r - sums) ** 2).sum()) for r in m]
    centred = (m - np.array([s / n for s in sums])).astype(float)
    v = centred.T @ centred / n
    values, comps = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:k]
    return [i for i, _ in x], deviation, np.abs(centred @ comps[:, order] / np.sqrt(values[order])), values[order] / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    good = [(i, (rng.normal(0, 1, 12) * np.linspace(1, 3, 12)).astype(np.float32).tolist()) for i in range(400)]
    bad = [(900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0] * 3), (905, []), (906, [3e38] * 12)]
    found = whitening.whiten(vectors(spark, [*good, *bad, good[0]]).repartition(7)).toPandas()
    ids, deviation, whitened, explained = brute_whitening([*good, good[0]])
    assert len(found) == len(ids) * 8 and set(found.n) == {len(ids)} and found.identity_error.max() < 1e-9
    for c, of in found.groupby("component"):
        assert np.allclose(of.explained, explained[c - 1], rtol=1e-9)
        assert np.allclose(sorted(of.whitened.abs()), sorted(whitened[:, c - 1]), atol=1e-8)
        assert sorted(of.deviation) == sorted(deviation) == sorted(map(int, of.deviation_exact))
        one = dict(zip(of.vec_id, of.whitened, strict=True))
        assert all(abs(abs(one[i]) - w) < 1e-8 for i, w in zip(ids, whitened[:, c - 1], strict=True))


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25])])).toPandas()
    assert len(one) == 4 and (one.whitened == 0).all() and (one.explained == 0).all() and (one.deviation == 0).all() and (one.identity_error == 0).all()
    line = whitening.whiten(vectors(spark, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [3.0, 3.0])])).toPandas()
    assert sorted(line[line.component == 2].whitened) == [0, 0, 0] and line.identity_error.max() < 1e-12
    assert np.allclose(sorted(line[line.component == 1].whitened), [-np.sqrt(1.5), 0, np.sqrt(1.5)])


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.integers(-(10**15), 10**15), min_size=2, max_size=2), min_size=1, max_size=8))
def test_deviations_are_exact(rows):
    x, n = np.array(rows, np.int64), 10**6
    sums = [7 * 10**20, -3]
    assert whitening.deviations(x, n, sums) == [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in rows]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 99))
def test_merged_moments_are_those_of_all(sizes, seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(-1000, 1000, (s, 3)) + 100_000 for s in sizes]
    m = None
    for b in blocks:
        m = whitening.merged(m, whitening.moments(b))
    x = np.concatenate(blocks)
    c = x - x.mean(0)
    assert m.n == len(x) and m.sums == x.sum(0).tolist() and np.allclose(m.scatter, c.T @ c, rtol=1e-9, atol=1e-6)
