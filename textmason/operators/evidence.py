"""Planned operations and their evidence records.

Everything about one file is an array in that file's row, so planning has no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.functions import patterns as P
from textmason.functions.text import fill, has_opportunity, two_decimals
from textmason.operators.rewrite import rewrite_chain
from textmason.operators.rules import RuleBook, matches_of


def mean_confidence(matches: Column) -> Column:
    total = F.aggregate(matches, F.lit(0.0), lambda acc, m: acc + m["confidence"])
    return F.when(F.size(matches) > 0, total / F.size(matches)).otherwise(0.0)


def certificate(
    owner: list[Column], original: Column, rewritten: Column, matches: Column, issued_at: Column
) -> Column:
    """Evidence record of one file; the id is a hash, so a retried task repeats it."""
    confidence = mean_confidence(matches)
    before, after = F.sha2(original, 256), F.sha2(rewritten, 256)
    proofs = F.transform(
        matches,
        lambda m: F.struct(
            m["rule_name"].alias("rule_name"),
            m["confidence"].alias("confidence"),
            m["proof_obligation"].alias("proof_obligation"),
            m["matched"].alias("matched_code"),
            m["replacement"].alias("replacement_code"),
        ),
    )
    guarantee = fill(
        P.GUARANTEE_SENTENCE, F.size(matches).cast("string"), two_decimals(confidence)
    )
    return F.struct(
        F.sha2(F.concat_ws("|", *[c.cast("string") for c in owner], before, after), 256).alias(
            "cert_id"
        ),
        issued_at.alias("issued_at"),
        before.alias("original_sha256"),
        after.alias("rewritten_sha256"),
        F.when(confidence >= P.VERIFIED_CONFIDENCE, "verified")
        .otherwise("unverified")
        .alias("status"),
        confidence.alias("confidence"),
        proofs.alias("proofs"),
        guarantee.alias("guarantee"),
    )


def changes_of(matches: Column) -> Column:
    """One change per match; a file without matches still has one generic change."""
    nothing = F.lit(None).cast("string")
    listed = F.transform(
        matches,
        lambda m: F.struct(
            m["rule_type"].alias("type"),
            m["description"].alias("description"),
            m["matched"].alias("matched"),
            m["replacement"].alias("replacement"),
        ),
    )
    generic = F.array(
        F.struct(
            F.lit(P.DEFAULT_CHANGE[0]).alias("type"),
            F.lit(P.DEFAULT_CHANGE[1]).alias("description"),
            nothing.alias("matched"),
            nothing.alias("replacement"),
        )
    )
    return F.when(F.size(matches) > 0, listed).otherwise(generic)


def plan_operations(
    files: DataFrame, book: RuleBook, issued_at: Column, keys=("project_id", "path")
) -> DataFrame:
    """One pending operation per readable file, rewritten text and evidence included."""
    owner = [F.col(k) for k in keys]
    content, rewritten, matches = F.col("content"), F.col("rewritten"), F.col("matches")
    return (
        files.filter(content.isNotNull())
        .select(
            *owner,
            content,
            rewrite_chain(content).alias("rewritten"),
            matches_of(content, book).alias("matches"),
        )
        .select(
            *owner,
            F.sha2(F.concat_ws("|", *[c.cast("string") for c in owner]), 256).alias("op_id"),
            content.alias("original"),
            rewritten,
            changes_of(matches).alias("changes"),
            has_opportunity(content).alias("opportunity"),
            F.lit("pending").alias("status"),
            F.lit(None).cast("string").alias("error"),
            F.when(
                F.size(matches) > 0, certificate(owner, content, rewritten, matches, issued_at)
            ).alias("certificate"),
        )
    )


def certificates(operations: DataFrame, keys=("project_id", "path")) -> DataFrame:
    """Evidence rows of the operations that have one."""
    return operations.filter(F.col("certificate").isNotNull()).select(*keys, "certificate.*")


def proofs(operations: DataFrame, keys=("project_id", "path")) -> DataFrame:
    """One row per proof, numbered in match order."""
    return operations.filter(F.col("certificate").isNotNull()).select(
        *keys, F.posexplode("certificate.proofs").alias("proof_ord", "proof")
    ).select(*keys, "proof_ord", "proof.*")
