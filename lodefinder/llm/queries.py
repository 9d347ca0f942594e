"""One query for each operator of this subpackage, over its whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefinder.llm import bpe, dedup, merkle, mixing, negatives, ngram, quality, sstable, tokens, topk, toxicity, urls, wfst
from lodefinder.llm.common import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode_digest(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.scores(read_table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ["doc_id"])


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(read_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, label = read_table(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = (
    op1_token_counts,
    op2_toxicity,
    op3_sentencepiece,
    op4_minhash_dedup,
    op5_lm_scores,
    op6_top_k,
    op7_token_table,
    op8_mixing,
    op9_url_filters,
    op10_quality_rules,
    op11_merkle_manifest,
    op12_byte_bpe,
    op13_hard_negatives,
)

#: Words of a text as a list, A-Z lower-cased by translate (lower() would change other letters too).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.doc_id
), least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)
"""

OP10_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), triples AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM docs, unnest(range(1, len(w) - 1)) AS t(i)
), often AS (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM triples),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM often, unnest(range(0, 3)) AS t(k) WHERE n > 1 GROUP BY r),
raw_lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
lines AS (
  SELECT r, line, sum(k) AS k FROM (
    SELECT r, regexp_replace(array_to_string({WORDS.format(f"translate(line, '{UPPER}', '{LOWER}')")}, ' '), '[0-9]+', '0', 'g') AS line,
      len({WORDS.format("line")}) AS k FROM raw_lines
  ) WHERE k > 0 GROUP BY r, line
), contents AS (SELECT r, array_to_string(list_sort(list(line)), chr(10)) AS content FROM lines GROUP BY r),
sizes AS (SELECT coalesce(source, chr(0)) AS source, count(*) AS docs FROM docs GROUP BY 1),
boiler AS (
  SELECT coalesce(d.source, chr(0)) AS source, l.line FROM lines l JOIN docs d USING (r) JOIN contents c USING (r)
  JOIN sizes s ON s.source = coalesce(d.source, chr(0))
  GROUP BY coalesce(d.source, chr(0)), l.line, s.docs
  HAVING count(DISTINCT c.content) > {quality.LINE_DOCS} AND count(DISTINCT c.content) > {quality.LINE_SHARE} * s.docs
), gone AS (
  SELECT l.r, sum(l.k) AS n FROM lines l JOIN docs d USING (r) JOIN boiler b ON b.source = coalesce(d.source, chr(0)) AND b.line = l.line GROUP BY l.r
), base AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, len(array_to_string(d.w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
    coalesce(h.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_line_words
  FROM docs d LEFT JOIN dups u USING (r) LEFT JOIN hit h USING (r) LEFT JOIN gone g USING (r)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (n_line_words > 0 AND (n_words - n_line_words < {quality.LEFT_WORDS}
  OR n_words - n_line_words < {quality.LEFT_SHARE} * n_words)) AS kept
FROM failed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force, round trips or held-out labels."""
    return {"op4_minhash_dedup": OP4_SQL, "op6_top_k": topk.ORACLE, "op10_quality_rules": OP10_SQL, "op13_hard_negatives": negatives.ORACLE}
