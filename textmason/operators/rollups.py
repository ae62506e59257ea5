"""Per-project summaries. Every grouping combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmason.functions import patterns as P
from textmason.functions.text import base_name, has_opportunity


def opportunities(files: DataFrame, include_payload: bool = True) -> DataFrame:
    """Files worth migrating, named by their last path segment."""
    name = base_name(F.col("path"))
    return files.filter(has_opportunity(F.col("content"), include_payload)).select(
        "project_id", name.alias("file"), name.alias("entity"),
        F.lit("api_migration").alias("type"),
    )


def project_analysis(files: DataFrame, entities: DataFrame) -> DataFrame:
    """File and entity counts; unreadable files count, analysis alone completes."""
    total = files.groupBy("project_id").agg(F.count("*").alias("total_files"))
    found = entities.groupBy("project_id").agg(F.count("*").alias("entities"))
    entity_count = F.coalesce("entities", F.lit(0))
    return total.join(found, "project_id", "left").select(
        "project_id",
        "total_files",
        entity_count.alias("entities"),
        (entity_count * P.ENTITY_COMPLEXITY).alias("complexity_score"),
        F.lit("completed").alias("analysis_status"),
    )


def execution_summary(operations: DataFrame, dry_run: bool) -> DataFrame:
    """Outcome counts; a dry run counts every operation as successful."""
    total = F.count("*")
    done = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    return operations.groupBy("project_id").agg(
        total.alias("total_operations"),
        (total if dry_run else done).alias("successful_operations"),
        (F.lit(0).cast("long") if dry_run else failed).alias("failed_operations"),
        F.lit(dry_run).alias("dry_run"),
    )


def report_summary(operations: DataFrame) -> DataFrame:
    confidence = F.col("certificate.confidence")
    total = F.coalesce(F.sum(confidence), F.lit(0.0))
    return operations.groupBy("project_id").agg(
        F.count("*").alias("total_operations"),
        F.count_if(F.col("status") == "completed").alias("completed_operations"),
        F.count_if(F.col("status") == "failed").alias("failed_operations"),
        total.alias("total_confidence"),
        (total / F.greatest(F.lit(1), F.count(confidence))).alias("average_confidence"),
    )


def changes_per_operation(operations: DataFrame, keys=("project_id", "path")) -> DataFrame:
    return operations.select(*keys, F.size("changes").alias("changes_count"))


def run_metrics(entities: DataFrame, found: DataFrame, operations: DataFrame) -> DataFrame:
    """Counts of one run and its mean confidence, null without evidence."""
    planned = operations.groupBy("project_id").agg(
        F.count("*").alias("operations"),
        F.avg("certificate.confidence").alias("mean_confidence"),
    )
    counts = [
        rows.groupBy("project_id").agg(F.count("*").alias(name))
        for rows, name in ((entities, "entities"), (found, "opportunities"))
    ]
    joined = planned
    for count in counts:
        joined = joined.join(count, "project_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "project_id", zero("entities"), zero("opportunities"), zero("operations"),
        "mean_confidence",
    )


def test_rollup(results: DataFrame, keys=("project_id", "run")) -> DataFrame:
    """Counts of a results table; no files at all is a success."""
    total, passed = F.count("file"), F.count_if(F.col("success"))
    return results.groupBy(*keys).agg(
        total.alias("total_files"),
        passed.alias("successful_tests"),
        (total - passed).alias("failed_tests"),
        (passed == total).alias("overall_success"),
    )


def compare_outcomes(source: DataFrame, target: DataFrame) -> DataFrame:
    """Two rollups agree if their success flags do, both failing included."""
    sides = [
        side.select("project_id", F.col("overall_success").alias(name))
        for side, name in ((source, "source_success"), (target, "target_success"))
    ]
    joined = sides[0].join(sides[1], "project_id", "full_outer")
    flags = [F.coalesce(c, F.lit(False)) for c in ("source_success", "target_success")]
    same = flags[0].eqNullSafe(flags[1])
    return joined.select(
        "project_id",
        flags[0].alias("source_success"),
        flags[1].alias("target_success"),
        same.alias("equivalent"),
        F.when(same, P.OUTCOMES_MATCH).otherwise(P.OUTCOMES_DIFFER).alias("note"),
    )


def best_match(scores: DataFrame, threshold: float = P.RENAME_THRESHOLD) -> DataFrame:
    """Best candidate per old id above the threshold; the earlier new id wins a tie."""
    best = F.max_by(F.struct("new_id", "score"), F.struct("score", -F.col("new_ord")))
    return (
        scores.filter(F.col("score") >= threshold)
        .groupBy("old_id")
        .agg(best.alias("best"))
        .select("old_id", "best.*")
    )


def first_pair(source: DataFrame, target: DataFrame) -> DataFrame:
    """First Python file of each side per project, in path order."""
    sides = [
        rows.filter(F.endswith("path", F.lit(".py"))).groupBy("project_id").agg(
            F.min("path").alias(name)
        )
        for rows, name in ((source, "source_file"), (target, "target_file"))
    ]
    return sides[0].join(sides[1], "project_id")


def limit_preview(files: DataFrame, shown: int = 3) -> DataFrame:
    """First files in path order and the number left out."""
    python = files.filter(F.endswith("path", F.lit(".py")))
    total = python.agg(F.count("*")).scalar()
    rest = F.greatest(total - shown, F.lit(0))
    return python.select("path").orderBy("path").limit(shown).select("path", rest.alias("more"))


def events_per_day(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def missing_dates(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Days between the first and the last event without any event."""
    days = events.select(F.to_date(ts).alias("day")).distinct()
    ends = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    span = ends.select(F.explode(F.sequence("first", "last")).alias("day"))
    return span.join(days, "day", "left_anti")


def distinct_dates(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Every day of the covered range and whether it has an event."""
    days = events.select(F.to_date(ts).alias("day")).distinct()
    return days.withColumn("has_event", F.lit(True)).unionByName(
        missing_dates(events, ts).withColumn("has_event", F.lit(False))
    )
