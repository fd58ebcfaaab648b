"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from liftlake.llm import byte_bpe, divergence_audit, hard_negatives, licences, mixture, overlap_join, page_text, passage_dedup, prefix_forest, secret_scan, spot_signatures, token_counts, toxicity
from liftlake.llm.common import table


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_report(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as vec")
    return prefix_forest.nearest(vectors, vectors.where("id % 20 = 0"), 20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.fingerprint_report(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_report(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.overlap_groups(table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.divergence_report(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_report(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
tokens AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
vocab AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
size AS (SELECT lang, count(*) AS v FROM vocab GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN vocab USING (lang, term) GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n FROM groups g JOIN vocab w ON g.lang = w.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term),
shares AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM cells JOIN size USING (lang)),
whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) JOIN size USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM size)),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
    FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q) WHERE rank <= 50)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""

OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc, doc_id, unnest(range(1, greatest(len(words) - 18, 1))) AS start, words FROM docs),
ranked AS (SELECT doc, start, rank() OVER (PARTITION BY array_to_string(words[start:start + 19], ' ') ORDER BY doc_id NULLS LAST, start) AS place FROM windows),
gone AS (SELECT DISTINCT doc, start + k AS place FROM ranked, range(20) AS steps(k) WHERE place > 1),
single AS (SELECT doc, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs),
kept AS (SELECT doc, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM single ANTI JOIN gone USING (doc, place) GROUP BY doc)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc)
"""

OP13_SQL = r"""
WITH points AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS a, a.id AS anchor_id, b.r AS b, b.id AS id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM points a JOIN points b ON a.id <> b.id AND len(a.vec) = len(b.vec) WHERE a.id % 50 = 0),
positives AS (SELECT a, anchor_id, b, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""

QUERIES = {f.__name__: f for f in (op1_source_mixture, op2_token_counts, op3_prefix_forest, op4_toxicity, op5_secret_scan, op6_spot_signatures, op7_license_scan, op8_byte_bpe, op9_ngram_jaccard_join, op10_page_text, op11_source_divergence, op12_substring_dedup, op13_hard_negatives)}
CHECK_SQL = {"op11_source_divergence": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
