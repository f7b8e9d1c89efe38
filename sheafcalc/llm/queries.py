"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from sheafcalc.llm import decontaminate, jaccard_join, language_id, mixing, pitman_yor, prefix_trie, quality_rules, sharding, suffix_dedup, toxicity, warc, whitening
from sheafcalc.llm.common import id_crc, table, work_dir
from sheafcalc.llm.token_counts import count_tokens


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_crc("doc_id", 5) != 0)
    return out.withColumn("held_out", id_crc("doc_id", 5) == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).drop("url")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_texts(table(spark, sf_dir, "documents"), with_text=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, id_crc("doc_id", 4) != 2)
    return language_id.label(docs, model).withColumn("held_out", id_crc("doc_id", 4) == 2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_classes(table(spark, sf_dir, "documents"), 4, 85, 100)


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pitman_yor.score(table(spark, sf_dir, "documents"), id_crc("doc_id", 7) != 2)
    return out.withColumn("held_out", id_crc("doc_id", 7) == 2)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sharding": op13_sharding,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op9_mixing": mixing.oracle_sql(), "op12_prefix_trie": prefix_trie.oracle_sql()}

# DuckDB has no base32; the digest is spelled from the bits of the hexadecimal SHA-1.
ORACLE_SQL["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
b AS (SELECT DISTINCT h, [CAST(('0x' || substr(h, 5 * i + 1, 5)) AS BIGINT) FOR i IN range(8)] AS five FROM p)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((five[1 + i // 4] >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (html) JOIN b USING (h)
"""

ORACLE_SQL["op3_decontaminate"] = """
WITH p AS (SELECT '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+' AS word),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), word) AS w FROM documents, p),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), word) AS w FROM benchmark, p),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + 9], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, k WHERE len(w) >= n)),
h AS (SELECT doc_id, s, n, item FROM o JOIN g USING (n, gram)),
x AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
y AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""
