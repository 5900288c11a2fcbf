"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact_dedup, html_text, language, mixing, near_dedup, substring_dedup, token_counts, token_output, topk, toxicity, whitening
from .common import keep, table, work_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_chunk_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_rollup_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under the first tokenizer; the second is added for all; documents labelled toxic
    are taken down; those of low quality are revised to their text without repeated lines. The last batch is
    sent twice and counts once."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = token_counts.Rollup(spark, work_path(spark, "rollup"))
    first, second = token_counts.VERSIONS
    shorter = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    rows = docs.select("doc_id", "source", "lang", token_counts.tokens(F.col("text"), first, second).alias("tokens"), token_counts.tokens(shorter, first, second).alias("revised"))
    rows = keep(rows, "counted")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    poor = labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    rollup.commit("ingest", token_counts.changes(rows, 1, first))
    rollup.commit("second-tokenizer", token_counts.changes(rows, 1, second))
    rollup.commit("takedown", token_counts.changes(rows.join(toxic, "doc_id", "left_semi"), -1, first, second))
    before = rows.join(poor, "doc_id", "left_semi")
    after = before.select("doc_id", "source", "lang", F.col("revised").alias("tokens"))
    for _ in range(2):
        rollup.commit("revision", token_counts.revision(before, after, first, second))
    return rollup.totals()


OP7_SQL = r"""
WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
poor AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM toxic)),
state AS (
  SELECT source, lang,
         CASE WHEN doc_id IN (SELECT doc_id FROM poor)
              THEN array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split(text, chr(10))), lambda l: struct_pack(p := list_position(string_split(text, chr(10)), l), l := l))), lambda s: s.l), chr(10))
              ELSE text END AS text
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM toxic)
), counted AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM state
  UNION ALL
  SELECT source, lang, 'runs-2', coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]+')), 0) FROM state
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM counted GROUP BY source, lang, tokenizer
"""


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""


def op12_suffix_sigma_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM w, (VALUES (1), (2), (3)) t(k)
  ) GROUP BY ALL
), sizes AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND a >= 10),
parts AS (
  SELECT lang, phrase, a, cut, array_to_string(p[1:cut], ' ') AS head, array_to_string(p[cut + 1:], ' ') AS tail
  FROM candidates, (VALUES (1), (2)) t(cut) WHERE cut < k
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3
  ) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, l.a DESC, phrase) AS rank, phrase, l.a, l, r, n, score
FROM lowest l LEFT JOIN inside i USING (lang, phrase) JOIN sizes USING (lang)
WHERE i.a IS NULL OR 100 * i.a < 50 * l.a
QUALIFY rank <= 2000
"""


def op13_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_main_text,
        op2_compression_language,
        op3_subword_toxicity,
        op4_pivot_topk,
        op5_source_mixing,
        op6_chunk_substring_dedup,
        op7_rollup_token_counts,
        op8_spaced_seed_decontamination,
        op9_minmax_near_dedup,
        op10_token_files,
        op11_grace_exact_dedup,
        op12_suffix_sigma_collocations,
        op13_chan_whitening,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_pivot_topk": OP4_SQL,
        "op7_rollup_token_counts": OP7_SQL,
        "op11_grace_exact_dedup": OP11_SQL,
        "op12_suffix_sigma_collocations": OP12_SQL,
    }
