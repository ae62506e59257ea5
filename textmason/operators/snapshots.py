"""Rollback and passthrough over tables of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmason.functions import patterns as P
from textmason.functions.text import is_code_file

FILE_KEYS = ["project_id", "path"]


def passthrough(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source files that are no code and that the target lacks."""
    other = source.filter(~is_code_file(F.col("path")))
    return other.join(target.select(*FILE_KEYS), FILE_KEYS, "left_anti")


def failed_operations(operations: DataFrame) -> DataFrame:
    return operations.filter(F.lower("status") == "failed")


def rollback_partial(target: DataFrame, operations: DataFrame) -> DataFrame:
    """Target without the files whose operation failed; they are not restored."""
    failed = failed_operations(operations).select(*FILE_KEYS)
    return target.join(failed, FILE_KEYS, "left_anti")


def backup_manifest(written: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(project_id, snapshot_id, backup_snapshot_id): the snapshot each write replaced.

    ``written`` lists (project_id, snapshot_id). A project's first snapshot has no backup.
    Snapshots never change, so recording the previous id stands in for a copy.
    """
    per_project = Window.partitionBy("project_id").orderBy("snapshot_id")
    found = (
        written.select("project_id", "snapshot_id")
        .distinct()
        .withColumn("backup_snapshot_id", F.lag("snapshot_id").over(per_project))
    )
    return found if manifest is None else manifest.unionByName(found)


def rollback_full(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of each project's backup snapshot; projects without one become empty."""
    backups = manifest.filter(F.col("backup_snapshot_id").isNotNull()).select(
        "project_id", F.col("backup_snapshot_id").alias("snapshot_id")
    )
    return files.join(backups, ["project_id", "snapshot_id"], "left_semi")


def consume_backup(manifest: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """Manifest after a full rollback: the restored projects have no backup left."""
    done = rolled_back.select("project_id", F.lit(True).alias("done")).distinct()
    kept = F.when(F.col("done").isNull(), F.col("backup_snapshot_id"))
    return manifest.join(done, "project_id", "left").select(
        "project_id", "snapshot_id", kept.alias("backup_snapshot_id")
    )


def rollback(
    strategy: str, files: DataFrame, snapshot_id: int, manifest: DataFrame, operations: DataFrame
) -> DataFrame:
    """Files of the target after rolling back one snapshot.

    ``files`` holds all snapshots. The manual and selective strategies change nothing.
    """
    if strategy not in P.ROLLBACK_STRATEGIES:
        raise ValueError(f"unknown rollback strategy {strategy!r}")
    target = files.filter(F.col("snapshot_id") == snapshot_id)
    if strategy == "full_rollback":
        return rollback_full(files, manifest.filter(F.col("snapshot_id") == snapshot_id))
    if strategy == "partial_rollback":
        return rollback_partial(target, operations)
    return target
