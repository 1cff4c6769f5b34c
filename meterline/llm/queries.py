"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterline.llm.bitpack import token_file_report
from meterline.llm.content import main_texts
from meterline.llm.decontaminate import leak_report
from meterline.llm.packing import pack_documents
from meterline.llm.prefixes import spliced_trie
from meterline.llm.quality import quality_report
from meterline.llm.rules import rule_report
from meterline.llm.secrets import secret_report
from meterline.llm.sharding import stratified_shards
from meterline.llm.simhash import simhash_report
from meterline.llm.substrings import repeat_report
from meterline.llm.toxicity import toxicity_report
from meterline.llm.whitening import whitening_report

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(table(spark, sf_dir, "documents"))


def op3_crf_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op5_bitpacked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(spark, table(spark, sf_dir, "documents"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"))


def op7_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(table(spark, sf_dir, "documents")).drop("failed_rule")


def op10_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spectrum_slicing_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"))


def op12_maximum_subsequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op13_rollup_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_crf_secret_scan": op3_crf_secret_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bitpacked_tokens": op5_bitpacked_tokens,
    "op6_stratified_shards": op6_stratified_shards,
    "op7_gru_toxicity": op7_gru_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_rule_cascade": op9_rule_cascade,
    "op10_empirical_bayes_quality": op10_empirical_bayes_quality,
    "op11_spectrum_slicing_whitening": op11_spectrum_slicing_whitening,
    "op12_maximum_subsequence_text": op12_maximum_subsequence_text,
    "op13_rollup_prefix_trie": op13_rollup_prefix_trie,
}

# DuckDB has no CRC-32 of its own: `taken` folds the bits of each byte.
PREFIX_TRIE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first_id,
    xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda crc, byte:
      list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)),
      4294967295), 4294967295) % 4 AS taken
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.first_id AND t.place <= i.taken
  UNION ALL
  SELECT i.conv_id, 1, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.taken),
paths AS (
  SELECT i.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.part, r.place) FILTER (WHERE r.place IS NOT NULL), []) AS path
  FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
prefixes AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM paths),
nodes AS (
  SELECT path[:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '') AS ends,
    coalesce(len(regexp_extract_all(max(path[depth].text), '[^\x20\x09-\x0D]+')), 0) AS words
  FROM prefixes GROUP BY path[:depth], depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[:n.depth - 1]),
children AS (SELECT prefix[:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.depth = l.depth AND c.prefix = l.prefix),
below AS (
  SELECT prefix[:up] AS prefix, up AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY prefix[:up], up)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, c.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN below b ON b.depth = c.depth AND b.prefix = c.prefix
"""

ORACLE: dict[str, str] = {"op13_rollup_prefix_trie": PREFIX_TRIE}
