"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character 3- to 5-grams, hashed to buckets; each bucket has an
embedding, a span's vector is the average of its words' bags, and a two-class linear softmax reads it. Spans
are single words, windows of WINDOW words, and the document: an insult in a long text must not be averaged
away, and a text that is mildly toxic all over has no worst word. Embeddings and softmax are trained by a
noisy-or over word spans; a logistic layer weighs the strongest word, the strongest window and the average.
Misspellings share most n-grams with the words they imitate, so unseen ones score like them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

WORDS = re.compile(r"\w+")
WIDTH, STRIDE = 48, 40
WINDOW = 5
NGRAMS = (3, 4, 5)
_M = np.random.default_rng(5).integers(1, 2**63, WIDTH + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and the model. At most `toxic_rows` + `clean_rows` labelled documents,
    those of the smallest id hashes, train the model with at most `max_chars` characters each."""

    toxic_rows: int = 1200
    clean_rows: int = 2400
    max_chars: int = 20_000
    buckets: int = 1 << 18
    dim: int = 8
    steps: int = 60
    rate: float = 0.3
    damping: float = 1e-4
    leak: float = 0.05  # share of toxic labels that no word explains; keeps wrong labels from blaming rare words


@dataclass(frozen=True)
class Model:
    """`word_scores` is embedding . (softmax weight 1 - weight 0) by bucket: all that scoring needs."""

    word_scores: np.ndarray
    bias: float
    slopes: tuple[float, ...]  # of the strongest word, the strongest window, the document
    shift: float


def words_of(text: str | None) -> list[str]:
    """Lower-case words in order; one longer than 48 characters counts as overlapping pieces."""
    found = WORDS.findall((text or "").lower())
    if any(len(w) > WIDTH for w in found):
        found = [w[at : at + WIDTH] for w in found for at in range(0, len(w) if len(w) > WIDTH else 1, STRIDE)]
    return found


def spans(logits: np.ndarray, bias: float) -> tuple[float, float, float]:
    """Logits of the strongest word, the strongest window of words and the whole document; those of a text without
    words are the bias. A span's logit is the average of its words', since the softmax is linear."""
    if not len(logits):
        return bias, bias, bias
    sums = np.r_[0.0, np.cumsum(logits, dtype=np.float64)]
    width = min(WINDOW, len(logits))
    return float(logits.max()), float((sums[width:] - sums[:-width]).max() / width), float(sums[-1] / len(logits))


def buckets_of(words: list[str], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, valid) by word: the word's own bucket, then those of its n-grams with end marks."""
    width = max((len(w) for w in words), default=0) + 2
    chars = np.zeros((len(words), width), np.uint64)
    body = np.array(words, dtype=f"U{width - 2}").view(np.uint32).reshape(len(words), width - 2)
    size = (body != 0).sum(1)
    chars[:, 1:-1] = body
    chars[:, 0] = 2
    chars[np.arange(len(words)), size + 1] = 3
    out, valid = [(chars * _M[:width]).sum(1, dtype=np.uint64)[:, None]], [np.ones((len(words), 1), bool)]
    for n in NGRAMS:
        if width < n:
            continue
        h = np.full((len(words), width - n + 1), np.uint64(n * 1_000_003), np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + chars[:, j : width - n + 1 + j]
        out.append(h)
        valid.append(np.arange(width - n + 1)[None, :] <= (size + 2 - n)[:, None])
    h = np.concatenate(out, 1)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int32), np.concatenate(valid, 1)


def word_logits(words: list[str], model: Model) -> np.ndarray:
    out = np.empty(len(words), np.float32)
    for at in range(0, len(words), 4096):
        b, valid = buckets_of(words[at : at + 4096], len(model.word_scores))
        out[at : at + 4096] = np.where(valid, model.word_scores[b], 0).sum(1) / valid.sum(1) + model.bias
    return out


def train(texts: list[str], toxic: np.ndarray, s: Settings = Settings()) -> Model:
    """Adam on the noisy-or loss, full batch; embeddings and softmax weights move together."""
    rng = np.random.default_rng(11)
    ordered = [words_of(t) for t in texts]
    bags = [sorted(set(words)) for words in ordered]
    vocab = {w: i for i, w in enumerate(sorted(set().union(*bags)))} if bags else {}
    if not vocab or toxic.all() or not toxic.any():  # nothing to tell apart
        rate = float(np.clip(toxic.mean(), 0.01, 0.99)) if len(toxic) else 0.01
        return Model(np.zeros(s.buckets, np.float32), 0.0, (0.0, 0.0, 0.0), float(np.log(rate / (1 - rate))))
    names = list(vocab)
    pairs = [(b[v], np.repeat(np.arange(at, at + len(v)), v.sum(1))) for at in range(0, len(names), 4096) for b, v in [buckets_of(names[at : at + 4096], s.buckets)]]
    buckets, word = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    used, buckets = np.unique(buckets, return_inverse=True)
    per_word = np.bincount(word, minlength=len(names))
    inverse = (1 / per_word).astype(np.float32)
    starts = np.r_[0, np.cumsum(per_word)[:-1]]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    doc_word = np.array([vocab[w] for b in bags for w in b])
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(bags)
    e = rng.normal(0, 0.01, (len(used), s.dim)).astype(np.float32)
    w = rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32)
    bias = np.array([0.0, -6.0], np.float32)
    params, moments = [e, w, bias], [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, bias)]
    for step in range(1, s.steps + 1):
        d = w[:, 1] - w[:, 0]
        z = np.add.reduceat((e @ d)[buckets], starts) * inverse + (bias[1] - bias[0])
        soft, sigmoid = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
        total = np.bincount(doc, soft[doc_word], len(bags))
        none = (1 - s.leak) * np.exp(-np.clip(total, 1e-4, 50))
        pull = np.where(toxic, -none / (1 - none), 1.0) * weight
        gz = np.bincount(doc_word, pull[doc], len(names)) * sigmoid / len(bags)
        gs = np.bincount(buckets, (gz * inverse)[word], len(used)).astype(np.float32)
        gd, gb = e.T @ gs, np.float32(gz.sum())
        grads = [gs[:, None] * d[None, :], np.stack([-gd, gd], 1), np.array([-gb, gb])]
        for p, g, m in zip(params, grads, moments, strict=True):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            p -= s.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + s.damping)
    scores = np.zeros(s.buckets, np.float32)
    scores[used] = e @ (w[:, 1] - w[:, 0])
    z = np.add.reduceat(scores[used][buckets], starts) / per_word + (bias[1] - bias[0])
    base = float(bias[1] - bias[0])
    found = np.array([spans(z[[vocab[w] for w in words]] if words else z[:0], base) for words in ordered])
    slopes, shift = _calibrate(found, toxic)
    return Model(scores, base, slopes, shift)


def _calibrate(found: np.ndarray, toxic: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic regression of the label on the spans' logits, by Newton steps with a small penalty. A span that
    would speak against the label it stands for is left out."""
    used = list(range(found.shape[1]))
    while True:
        x = np.concatenate([found[:, used], np.ones((len(found), 1))], 1)
        beta = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (np.maximum(p * (1 - p), 1e-6) / len(x))[:, None]).T @ x + 1e-4 * np.eye(len(beta))
            beta -= np.clip(np.linalg.solve(h, x.T @ (p - toxic) / len(x) + 1e-4 * beta), -2, 2)
        against = [u for u, v in zip(used, beta, strict=False) if v < 0]
        if not against:
            slopes = dict(zip(used, beta.tolist(), strict=False))
            return tuple(slopes.get(i, 0.0) for i in range(found.shape[1])), float(beta[-1])
        used = [u for u in used if u != against[-1]]


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, s: Settings = Settings()) -> DataFrame:
    """(doc_id, text, toxic) of the bounded training sample, a row per id and label. `usable` is a condition on doc_id.
    Only ids that have a text are chosen; they are at most toxic_rows + clean_rows rows, which bounds the broadcast that
    finds their texts. Of several texts of an id the least counts; of one of more than `max_chars` characters, a part of
    that length at a place that the hash of the id tells. Ids of shorter texts come first, since a part may lack what
    earned the label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(usable).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0).where(usable)
    known = known.join(texts.groupBy("doc_id").agg(F.min(F.length("text") > s.max_chars).alias("cut")), "doc_id")
    order = [F.col("cut"), F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(s.toxic_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(s.clean_rows)).drop("cut")
    start = 1 + F.pmod(F.xxhash64(F.lit("at"), "doc_id"), F.greatest(F.length("text") - s.max_chars, F.lit(0)) + 1).cast("int")
    part = F.substr("text", start, F.lit(s.max_chars))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(part).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, usable, s: Settings = Settings()) -> Model:
    rows = sorted((r.doc_id, r.text, r.toxic) for r in labelled_sample(docs, labels, usable, s).collect())
    return train([r[1] for r in rows], np.array([r[2] == 1 for r in rows], bool), s)


_CACHE: dict[int, tuple[str, dict[str, float]]] = {}
CACHED_WORDS = 50_000


def scorer(model: Model):
    """A pandas UDF: score in 0..1 by text. Each worker remembers up to 50,000 words' logits."""
    shared = model
    mark = hash((model.word_scores.tobytes(), model.bias, model.slopes, model.shift))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known = _CACHE.setdefault(0, (mark, {}))
        if known[0] != mark:
            known = _CACHE[0] = (mark, {})
        logits, out = known[1], np.empty((len(texts), 3))
        for at, text in enumerate(texts):
            words = words_of(text)
            new = [w for w in set(words) if w not in logits]
            if len(logits) + len(new) > CACHED_WORDS:
                logits.clear()
                new = list(set(words))
            logits.update(zip(new, word_logits(new, shared).tolist(), strict=True))
            out[at] = spans(np.fromiter(map(logits.__getitem__, words), np.float32, len(words)), shared.bias)
        return pd.Series(1 / (1 + np.exp(-np.clip(out @ np.array(shared.slopes) + shared.shift, -30, 30))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Labels of ids whose crc32 modulo 5 is 0 are never used. Null and empty texts get the score of a text
    without words. Rows that repeat an id are scored each; labels that repeat count once, those that contradict
    each other count both; an empty table gives an empty table; without labels of both kinds every text scores
    the labels' share. Texts are read whole; columns of other names aren't looked at."""
    model = fit(docs, labels, crc_mod("doc_id", 5) != 0, s)
    scored = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`docs`, with all columns, without those scored 0.5 or more; nulls, repeats and empty tables as in `toxicity`."""
    model = fit(docs, labels, crc_mod("doc_id", 5) != 0, s)
    return docs.where(scorer(model)("text") < 0.5)
