"""HTML extraction, language, toxicity: edge cases and held-out accuracy."""

from __future__ import annotations

import re
import time
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import zstandard

from pyspark.sql import functions as F

from corvane.llm import html_text, language, queries, toxicity

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="test tables are missing")
W = html_text.fit()


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<p>A &amp; B &#233;&nbsp;c</p>", "A & B é c"),
        ("<article><h1>T</h1><p>one\n  two<p>three<br>four</article><footer>f</footer>", "T\none two\nthree four"),
        ("<nav><a href='/'>x</a></nav><article><p>long text here</p><div class='ad'>buy</div><p>more</p></article><aside>s</aside>", "long text here\nmore"),
        ("<main><p>a b c d</p><section class='comments'><p>reader says</p></section></main>", "a b c d"),
        ("<article><p>x < y and z</p><script>var t='</p>'</script><style>p{}</style></article>", "x < y and z"),
        ("<header><p>Site</p></header><article><header><h1>Title words</h1></header><p>body words here</p></article>", "Title words\nbody words here"),
        ("<div class='cookie-notice'><p>We use cookies on this site to track you</p></div><div class='post-content'><p>real text of the post</p></div>", "real text of the post"),
        ("<article><form><input value='1'>Name</form><p>kept text</p><!-- <p>gone</p> --></article>", "kept text"),
        ("<article><p>cut off in a tag <b", "cut off in a tag"),
        ("<article><p>the story is here</p></article><div class='related'><article><p>a teaser of another</p></article></div><article class='comment'><p>I say so</p></article>", "the story is here"),
        ("<div class='sidebar-layout'><article><p>the story</p><p>ends.</p></article></div>", "the story\nends."),
        ("<body class='has-sidebar'><article><p>the words</p></article></body>", "the words"),
    ],
)
def test_main_text(page, expected):
    assert html_text.main_text(page, W) == expected


STORY = "<p>The first paragraph of the story with some words in it.</p><p>And a second one that goes on for a while.</p>"
TOLD = "The first paragraph of the story with some words in it.\nAnd a second one that goes on for a while."


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<article>{STORY}<div class='legal-analysis'><p>A court has to decide on it.</p></div></article>", TOLD + "\nA court has to decide on it."),
        (f"<article>{STORY}<table class='form-results'><tr><td>Won</td><td>Lost twice</td></tr></table></article>", TOLD + "\nWon\nLost twice"),
        (f"<article>{STORY}</article><div class='x2'>We use cookies on this site. Accept all cookies.</div>", TOLD),
        (f"<article>{STORY}</article><div><p>Dear reader, mind this message about things.</p></div>", TOLD),
        (f"<div>We use cookies on this site. Accept all cookies.</div><div>{STORY}</div><div>\u00a9 2024 Some Company. All rights reserved. Terms. Privacy.</div>", TOLD),
        (f"<article>{STORY}<section class='post-comments'><p>I liked it.</p><p>Me too, a lot.</p></section></article>", TOLD),
        (f"<main>{STORY}<aside><p>Another story of ours.</p></aside></main>", TOLD),
        ("<div>Only text without a tag of its own that says what it is and goes on for some time.</div>", "Only text without a tag of its own that says what it is and goes on for some time."),
    ],
)
def test_no_name_decides_alone(page, expected):
    assert html_text.main_text(page, W) == expected


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<div>One line.</div><div>Second line of words.</div>", "One line.\nSecond line of words."),
        ("<div>Short text here.</div>", "Short text here."),
        ("just text", "just text"),
        ("<h1>Title</h1><div>Short text.</div><div>More of it.</div>", "Title\nShort text.\nMore of it."),
        ("<ul><li><a href='/a'>Home</a></li></ul><div>One line.</div>", "One line."),
        ("<div>We use cookies on this site. Accept all cookies.</div>", ""),
        ("<nav><a href='/'>x</a></nav>", ""),
    ],
)
def test_pages_of_short_blocks(page, expected):
    assert html_text.main_text(page, W) == expected


def test_extraction_equals_a_search_of_all_regions():
    for page in html_text.labelled_pages()[:40]:
        seq = html_text.sequence(page, html_text._judge(W))
        sums = np.r_[0, np.cumsum([html_text.score(f, t, W) for f, t in seq])]
        best = max((sums[j] - sums[i] for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)), default=0)
        start, end = html_text.best_region(np.array([html_text.score(f, t, W) for f, t in seq]))
        assert abs(sums[end] - sums[start] - max(best, 0)) < 1e-6
        kept = [t for f, t in seq[start:end] if f[0] == "w"]
        assert "".join("".join(kept).split()) == "".join(html_text.main_text(page, W).split()) or "&" in page


def test_labelled_pages_are_extracted():
    right = total = 0
    for page in html_text.labelled_pages():
        inside = " ".join(re.findall("\x02([^\x03]*)\x03", page))
        content = re.sub("<[^>]*>", " ", inside).split()
        got = html_text._unmarked(html_text.main_text(page, W)).split()
        total += max(len(content), len(got))
        right += sum((Counter(content) & Counter(got)).values())
    assert right / total > 0.88  # some boxes have neither a name nor words that tell them from content


def test_nesting_costs_no_square():
    began = time.perf_counter()
    assert html_text.main_text("<div>" * 20_000 + "<p>some words here</p>" + "</div>" * 20_000, W) == "some words here"
    html_text.main_text("<div>" * 20_000 + "x</p></span>" * 20_000, W)
    html_text.main_text("<b><div>" + "<span>" * 20_000 + "</b>" * 20_000, W)
    html_text.main_text("<p>" + "<span>" * 20_000 + "<foo></foo>" * 20_000, W)
    html_text.main_text("<p><button>" + "<span>" * 20_000 + "<div></div>" * 20_000, W)
    assert time.perf_counter() - began < 10


def test_best_region_is_the_maximum():
    rng = np.random.default_rng(3)
    for _ in range(50):
        s = rng.normal(0, 1, 12).round(2)
        start, end = html_text.best_region(s)
        best = max([0.0, *(s[i:j].sum() for i in range(12) for j in range(i + 1, 13))])
        assert abs(s[start:end].sum() - best) < 1e-9


def test_weights_come_from_labelled_pages():
    assert W["w:m--p"] > 0 and W["w:-a--"] < 0 and all(v < 0 for k, v in W.items() if k[0] in "tx")
    assert W["b:l:comments"] > 0 > W["b:in"] and W["v:cookies"] < 0 and W == html_text.fit()


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", "x"), (1, "u", "<p>a b</p>", "x"), (2, None, None, "y"), (None, "v", "<p>" + "word " * 50_000 + "</p>", "z")], "page_id long, url string, html string, text string")
    out = sorted(((r.page_id or 0, r.n_chars) for r in html_text.extract(df).collect()))
    assert out == [(0, 249_999), (1, 3), (1, 3), (2, 0)]
    assert html_text.extract(df.limit(0)).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def test_language_edges(spark):
    en, de = "the house and the garden are with us and this that ", "der garten und das haus sind mit uns und nicht auch "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de", "s", 1, 0.0) for i in range(40)]
    rows += [(100, None, "en", "s", 0, 0.0), (101, "", None, "s", 0, 0.0), (102, "12 !?", "en", "s", 0, 0.0), (105, "\u00b2 \u00bd \u2167 \u2460 _ 7", "en", "s", 0, 0.0), (103, en * 4000, None, None, 0, 0.0), (None, de, None, None, 0, 0.0), (104, en, "en", "s", 1, 0.0), (104, en, "en", "s", 1, 0.0)]
    out = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(out) == len(rows)
    got = dict((i, p) for i, p, _ in out)
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(40))
    assert (got[100], got[101], got[102], got[105], got[103], got[None], got[104]) == ("und", "und", "und", "und", "en", "de", "en")
    assert all(0 <= s <= 1 for _, _, s in out)
    empty = spark.createDataFrame([], DOCS)
    assert language.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None, "s", 1, 0.0)], DOCS)
    assert language.identify(unlabelled).first().lang_pred == "und"


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(4)
    vocabularies = [["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(12)] for _ in range(230)]
    learnt = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2][:460]
    rows = [(i, " ".join(vocabularies[n // 2]), f"l{n // 2:03d}", "s", 1, 0.0) for n, i in enumerate(learnt)]
    df = spark.createDataFrame(rows, DOCS)
    assert set(language.training_rows(df)) == {r[2] for r in rows}
    got = {(r.doc_id, r.lang_pred) for r in language.identify(df).collect()}
    assert got == {(r[0], r[2]) for r in rows}


def test_repeated_ids_hide_no_language(spark):
    """A language whose rows all have one id is learnt, and a frequent id brings one row to the driver."""
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2][:401]
    rows = [(i, f"the house and the garden {i}", "en", "s", 1, 0.0) for i in ids[:400]] + [(ids[400], f"der garten und das haus {n}", "de", "s", 1, 0.0) for n in range(4000)]
    sample = language.training_rows(spark.createDataFrame(rows, DOCS))
    assert len(sample["en"]) == 96 and sample["de"] == ["der garten und das haus 0"]


def test_letters_are_those_of_unicode():
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
    assert all(c.isalpha() or c == " " or unicodedata.category(c)[0] == "M" for c in language.letters(text))
    assert language.letters("A\u00b2b \u00bd1_c") == "a b c"


def test_dictionaries_are_of_equal_sizes():
    dicts = language.dictionaries({"a": ["one two three"] * 3 + ["four " * 50], "b": ["x y"], "c": ["12 !"]})
    assert set(dicts) == {"a", "b"} and len(dicts["a"]) == len(dicts["b"])


def test_prediction_is_the_smallest_size():
    """Against plain compression with each dictionary, and the margin of rejection."""
    dicts = language.dictionaries({"en": ["the house and the garden are with us and this that"] * 2, "de": ["der garten und das haus sind mit uns und nicht auch"]})
    model = language.Classifier(dicts)
    for text in ("the garden and the house", "das haus und der garten", "xyz", "the haus and der garden und that"):
        sizes = {}
        for name, data in dicts.items():
            coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[name] = len(coder.compress(language.letters(text).encode()))
        best = min(sorted(sizes), key=sizes.get)
        lang, score, rejected = model.predict(text)
        assert lang == best and 0.5 <= score <= 1
        assert rejected == (1 - sizes[best] / max(sizes.values()) < 0.01)


@needs_data
def test_language_accuracy(spark):
    got = queries.op2_compression_language(spark, str(DATA)).where("held_out").select("doc_id", "lang_pred")
    both = got.join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").toPandas()
    assert (both.lang_pred == both.lang).mean() > 0.9
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id)


def test_toxicity_learns_subwords():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    texts, toxic = [], []
    for i in range(300):
        w = list(rng.choice(words, 60))
        if i % 3 == 0:
            w[int(rng.integers(60))] = ["wretched", "stupid"][i % 2]
        texts.append(" ".join(w))
        toxic.append(i % 3 == 0)
    m = toxicity.train(texts, np.array(toxic))
    logit = lambda w: float(toxicity.word_logits([w], m)[0])
    assert logit("wretched") > 0 > logit(words[0])
    assert logit("wretchedd") > logit(words[0]) and logit("wretchd") > logit(words[0])


def test_spans_against_brute_force():
    model = toxicity.Model(np.random.default_rng(2).normal(0, 1, 1 << 10).astype(np.float32), -0.5, (0.7, 0.2, 0.1), 0.3)
    for text in ("one", "one two three four five six seven one", "", None, "a b " * 40):
        words = [w for w in re.findall(r"\w+", (text or "").lower())]
        z = [float(toxicity.word_logits([w], model)[0]) for w in words]
        if z:
            width = min(toxicity.WINDOW, len(z))
            expected = (max(z), max(np.mean(z[i : i + width]) for i in range(len(z) - width + 1)), np.mean(z))
        else:
            expected = (-0.5,) * 3
        assert np.allclose(toxicity.spans(np.array(z), model.bias), expected, atol=1e-5)


def test_repeated_labelled_ids_give_one_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en", "s", 0, 0.0) for i in range(50)] + [(2, "b", "en", "s", 0, 0.0)], DOCS)
    labels = spark.createDataFrame([(1, 1, 1)] * 20 + [(2, 0, 0)] * 20, "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(docs, labels, F.lit(True)).count() == 2


def test_labels_without_documents_take_no_place(spark):
    texts = spark.createDataFrame([(i, f"text {i}", "en", "s", 0, 0.0) for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0 or i >= 200)) for i in range(4200)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(texts, labels, F.lit(True)).toPandas()
    assert (sample.toxic == 1).sum() == (sample.toxic == 0).sum() == 100


def test_long_labelled_texts_are_cut(spark):
    texts = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * 8000, "en", "s", 0, 0.0) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(texts, labels, F.lit(True)).toPandas()
    assert len(sample) == 60 and (sample.text.str.len() == 20_000).all()
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.toxicity(texts, labels).collect())


def test_toxicity_edges(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = spark.createDataFrame([(1, None, "en", "s", 0, 0.0), (2, "", "en", "s", 0, 0.0), (3, "word " * 30_000, "en", "s", 0, 0.0), (None, "x" * 5000, None, None, 0, 0.0), (4, "a", "en", "s", 0, 0.0), (4, "a", "en", "s", 0, 0.0)], DOCS)
    none = spark.createDataFrame([], labels)
    out = toxicity.toxicity(docs, none).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == 0 for r in out)
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    one_kind = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, None, None)], labels)
    assert [r.predicted for r in toxicity.toxicity(docs, one_kind).collect()] == [0] * 6


@needs_data
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_subword_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.predicted[got.toxic == 1].mean() > 0.9 and got.predicted[got.toxic == 0].mean() < 0.02
