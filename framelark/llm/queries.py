"""Queries over the training-data tables and, where SQL can say the same,
their DuckDB statements.  Each takes (spark, sf_dir) and covers whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, main_text, media, mixing, near_dedup, quality_rules, quality_score, url_filter, warc
from .common import remainder, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: targets by water-filling, words taken of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a WARC record for every page, then read the archives back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, and whether it stays."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on two thirds of the documents, predict the language of all."""
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs, remainder(F.col("doc_id"), 3) != 1)
    return language.identify(docs, net).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count over every document, label its lines, keep it or not."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and give the digests of both."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document's bytes as an image, refer to it from an interleaved
    document, resolve the reference and give what the stored bytes hold."""
    return media.document_media(spark, table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url: by the longest rule that fits, else by trees
    trained on the urls that rules decide."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op10_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from three quarters of the labelled documents, score all."""
    return quality_score.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_near_dedup": op3_near_dedup,
    "op4_language": op4_language,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_media": op7_media,
    "op8_url_filter": op8_url_filter,
    "op9_main_text": op9_main_text,
    "op10_quality_score": op10_quality_score,
}

SQL = {
    "op2_warc": r"""
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
digests AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(string_split(sha1(body), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits
  FROM bodies),
named AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5*i+1] AS INT) + 8 * CAST(bits[5*i+2] AS INT) + 4 * CAST(bits[5*i+3] AS INT) + 2 * CAST(bits[5*i+4] AS INT) + CAST(bits[5*i+5] AS INT) AS BIGINT), 1)), '') AS payload_digest
  FROM digests),
lasts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM named)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last IS NOT NULL AND (page_id IS NULL OR page_id < last) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND (page_id IS NULL OR page_id < last) THEN last END AS refers_to
FROM lasts
""",
    "op1_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sizes),
ratios AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM weighted),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
water AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level * weight < cap),
targets AS (
  SELECT source, source_size,
         CASE WHEN water.level IS NULL OR ratio <= water.level THEN CAST(cap AS DOUBLE) ELSE water.level * weight END AS target
  FROM levels LEFT JOIN water ON true),
split AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM targets),
shares AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS extra FROM split),
groups AS (SELECT source, place, sum(size) AS held FROM docs GROUP BY source, place),
running AS (
  SELECT *, coalesce(sum(held) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM groups),
edge AS (
  SELECT r.source AS s, r.place AS last_place, extra - ahead AS last_words, held AS last_size
  FROM running r JOIN shares ON r.source IS NOT DISTINCT FROM shares.source WHERE ahead <= extra AND extra < ahead + held)
SELECT doc_id, size, shares.source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (whole + CASE WHEN place < last_place THEN 1 ELSE 0 END) * size
            + CASE WHEN place = last_place THEN CAST(floor(CAST(last_words * size AS DOUBLE) / last_size) AS BIGINT) ELSE 0 END END AS BIGINT) AS taken
FROM docs JOIN shares ON docs.source IS NOT DISTINCT FROM shares.source LEFT JOIN edge ON docs.source IS NOT DISTINCT FROM edge.s
""",
}
