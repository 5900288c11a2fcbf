"""Language identification by compression.

For each language a zstandard dictionary holds raw text of that language. A text is compressed with every
dictionary in turn; the one that gives the fewest bytes names the language. Where the best and the second
best hardly differ, the answer is marked as rejected.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

UNKNOWN = "und"
#: Numbers that `\w` has beside letters and decimal digits, such as fractions and superscripts.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
NO_LETTER, NUMBER = re.compile(r"[\W\d_]+"), re.compile(f"[{re.escape(NUMBERS)}]+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the search. Per language the `docs_per_language` ids of the
    smallest hashes give at most `chars_per_doc` characters each to the dictionary, from a place that the hash
    of the id tells."""

    docs_per_language: int = 96
    chars_per_doc: int = 1200
    block: int = 8192
    level: int = 6
    margin: float = 0.01


def letters(text: str | None) -> str:
    """Lower-case words of letters, one space apart; marks, digits and layout say little about a language."""
    clean = NO_LETTER.sub(" ", (text or "").lower()).strip()
    if clean.replace(" ", "").isalpha():
        return clean
    return " ".join(NUMBER.sub(" ", clean).split())


def training_rows(docs: DataFrame, s: Settings = Settings()) -> dict[str, list[str]]:
    """Sample texts by language. The number of ids by language comes first; it gives the share of ids, by hash,
    that suffices for each language. Rows that repeat an id count once, with the least of their parts, so that about
    twice `docs_per_language` rows a language at most come to the driver, however large the table is and however often
    an id repeats. Every language has a sample: it grows with their number, not with the rows."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod("doc_id", 4) != 2)
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy("lang").collect()
    shares = [int(min(1.0, 2.0 * s.docs_per_language / max(1, r.n)) * (1 << 30)) + 1 for r in counts]
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([r.lang for r in counts], pa.string()), "share": pa.array(shares, pa.int64())}))
    place = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30))
    start = 1 + F.pmod(F.xxhash64(F.lit("at"), "doc_id"), F.greatest(F.length("text") - s.chars_per_doc, F.lit(0)) + 1).cast("int")
    sample = known.select("lang", "doc_id", F.substr("text", start, F.lit(s.chars_per_doc)).alias("text"), place.alias("place"))
    sample = sample.join(shares, "lang").where("place < share").groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.lang, r.place, r.doc_id, r.text)):
        texts = out.setdefault(r.lang, [])
        if len(texts) < s.docs_per_language:
            texts.append(r.text)
    return out


def dictionaries(sample: dict[str, list[str]]) -> dict[str, bytes]:
    """Raw-content dictionaries of equal sizes, so that none wins by being larger: smaller ones are repeated. Texts that
    repeat count once; a language whose sample has no letter has no dictionary."""
    joined = {lang: " ".join(dict.fromkeys(filter(None, map(letters, texts)))).encode() for lang, texts in sample.items()}
    joined = {lang: data for lang, data in joined.items() if data}
    size = max(map(len, joined.values()), default=0)
    return {lang: ((data + b" ") * -(-size // len(data)))[:size] for lang, data in sorted(joined.items())}


class Classifier:
    def __init__(self, dicts: dict[str, bytes], s: Settings = Settings()):
        self.names, self.settings = list(dicts), s
        self.coders = []
        for data in dicts.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=s.level)
            self.coders.append(zstandard.ZstdCompressor(level=s.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> np.ndarray:
        """Compressed bytes by language: the sum over blocks of the whole text."""
        step = self.settings.block
        return np.array([sum(len(c.compress(data[at : at + step])) for at in range(0, len(data), step)) for c in self.coders], float)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        clean = letters(text)
        if not clean or not self.names:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(clean.encode())
        order = np.argsort(sizes, kind="stable")
        best = int(order[0])
        if len(order) == 1:
            return self.names[best], 1.0, False
        margin = float(1 - sizes[best] / sizes[order[1]])
        odds = np.exp(-np.minimum((sizes - sizes[best]) * 8 * np.log(2) / 4, 50))
        return self.names[best], float(1 / odds.sum()), margin < self.settings.margin


_MADE: dict[int, Classifier] = {}


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, rejected.

    Only text and lang of documents whose crc32 modulo 4 is not 2 are learnt from, and every language of these
    is learnt; a prediction looks at the text alone, whole, once with each language. Null texts and texts without a letter are `und` with score 0, and so is every text if
    nothing could be learnt. Ties go to the first language by code point. Repeated rows are predicted each;
    an empty table gives an empty table; columns of other names aren't looked at."""
    dicts = dictionaries(training_rows(docs, s))
    mark = hash(tuple(dicts.items()))

    def run(batches):
        if mark not in _MADE:
            _MADE.clear()
            _MADE[mark] = Classifier(dicts, s)
        model = _MADE[mark]
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    source = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return source.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")
