"""One registered query for each operator of this folder, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textmason.llm import (
    byte_bpe, decontaminate, divergence, jaccard_join, language_id, licenses, quality,
    suffix_dedup, token_counts, token_files, url_filter, warc, whitening,
)
from textmason.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(table(spark, sf_dir, "documents"), benchmark).drop("body")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).drop("purity")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read_tokens(
        token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer, end_id=1)
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.with_revisits(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_archives(warc.write_archives(records))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("digest")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op10_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the number of links of each document."""
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.jaccard_components(docs, counted=True).drop("digest")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_quality_rules, op3_license_scan, op4_decontaminate,
        op5_token_counts, op6_url_filter, op7_token_files, op8_byte_bpe, op9_warc, op10_jaccard_join,
        op11_source_divergence, op12_whitening, op13_language_id,
    )
}

#: Further results of these operators.
MORE_QUERIES: dict[str, Query] = {"op10_jaccard_links": op10_jaccard_links}

# base32 of a digest: its 160 bits in groups of five
WARC_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), digits AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS largest,
    array_to_string(list_transform(range(1, 41), lambda i:
      ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011',
       '1100','1101','1110','1111'][strpos('0123456789abcdef', hex[i])]), '') AS bits FROM hashed
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT
      + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT]), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM digits
"""
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op9_warc": WARC_SQL,
    "op11_source_divergence": divergence.ORACLE,
}
