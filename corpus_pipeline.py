"""A training-data pipeline over ``documents``: five stages, each stored before the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmason.llm import byte_bpe, decontaminate, jaccard_join, quality, suffix_dedup
from textmason.llm.common import table
from textmason.session import cut_lineage, forget


def _free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` hasn't."""
    name = "_body"
    while name in docs.columns:
        name += "_"
    return name


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality.repetition_quality(docs, carry=True).filter("kept").select("rest.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by shingles, the one with the least doc_id.

    Of fully repeated rows one is kept; a group whose documents all lack a doc_id is kept.
    """
    groups = jaccard_join.jaccard_components(docs)
    chosen = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_doc_id"), F.col("digest").alias("_digest")
    ).distinct()
    body = _free_name(docs)
    rows = docs.withColumn(body, jaccard_join.digest_of(F.coalesce("text", F.lit(""))))
    same = rows["doc_id"].eqNullSafe(chosen["_doc_id"]) & (rows[body] == chosen["_digest"])
    return (
        rows.join(chosen, same, "left_semi").dropDuplicates(["doc_id", body])
        .select(*docs.columns)
    )


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of long strings that start earlier; n_chars follows the text."""
    found = suffix_dedup.remove_repeats(docs, carry=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return found.select(*(
        (new[name] if name in new else F.col("rest")[name]).alias(name) for name in docs.columns
    ))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    found = found.filter("contaminated").select(
        F.col("doc_id").alias("_doc_id"), F.col("body").alias("_hash")
    )
    body = _free_name(docs)
    rows = docs.withColumn(body, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = rows["doc_id"].eqNullSafe(found["_doc_id"]) & (rows[body] == found["_hash"])
    return rows.join(found, same, "left_anti").select(*docs.columns)


def encode_as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, counted and digested, and the digest of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", keep_by_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", remove_repeated_strings),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_as_tokens),
]
#: SQL can't express the merges of the last stage; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is stored and read by the next."""
    docs, stored = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        if stored is not None:
            forget(stored)
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)
