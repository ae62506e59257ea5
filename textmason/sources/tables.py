"""Snapshot tables and JSON reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmason.operators.snapshots import (
    backup_manifest, consume_backup, passthrough, rollback_full,
)
from textmason.session import cut_lineage, delete_folder, folder_exists, passing_shuffles

PROOF = (
    "STRUCT<rule_name: STRING, confidence: DOUBLE, proof_obligation: STRING, "
    "matched_code: STRING, replacement_code: STRING>"
)
CERTIFICATE = (
    "STRUCT<cert_id: STRING, issued_at: TIMESTAMP, original_sha256: STRING, "
    "rewritten_sha256: STRING, status: STRING, confidence: DOUBLE, "
    f"proofs: ARRAY<{PROOF}>, guarantee: STRING>"
)
CHANGES = "ARRAY<STRUCT<type: STRING, description: STRING, matched: STRING, replacement: STRING>>"
SNAPSHOT_SCHEMA = (
    f"project_id BIGINT, path STRING, op_id STRING, content STRING, changes {CHANGES}, "
    f"opportunity BOOLEAN, status STRING, error STRING, certificate {CERTIFICATE}, "
    "snapshot_id INT"
)
MANIFEST_SCHEMA = (
    "snapshot_id INT, folder STRING, version BIGINT, project_id BIGINT, files BIGINT"
)
PROJECT_SECTION = (
    "project_id BIGINT, project_info STRUCT<name: STRING, source_path: STRING, "
    "target_path: STRING, created_at: TIMESTAMP, status: STRING, completed_at: TIMESTAMP>, "
    "transformation_summary STRUCT<total_operations: BIGINT, completed_operations: BIGINT, "
    "failed_operations: BIGINT, total_confidence: DOUBLE, average_confidence: DOUBLE>"
)
OPERATION_SECTION = (
    "project_id BIGINT, id STRING, file STRING, status STRING, changes_count INT, "
    f"proof_certificate {CERTIFICATE}"
)
ENTITY_SECTION = (
    "project_id BIGINT, name STRING, module STRING, language STRING, "
    "signature STRUCT<args: ARRAY<STRUCT<name: STRING, type: STRING>>>"
)
SECTIONS = {
    "project": PROJECT_SECTION,
    "operations": OPERATION_SECTION,
    "api_entities": ENTITY_SECTION,
}


def write_snapshot(
    operations: DataFrame, root: str, snapshot_id: int, others: DataFrame | None = None
) -> DataFrame:
    """Store rewritten files and their evidence as one immutable snapshot.

    ``others`` (project_id, path, content) are carried unchanged, with status ``copied``, where
    no operation has their path; they are no operations.

    Returns the executed operations as stored: texts are written once and later steps
    read only the columns they need. Writing the same snapshot again replaces it whole, once
    the new one is complete. A row that cannot be written is marked, not raised.
    """
    failed = F.col("rewritten").isNull() | F.col("error").isNotNull()
    rows = operations.select(
        "project_id", "path", "op_id", F.col("rewritten").alias("content"), "changes",
        "opportunity",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.coalesce("error", F.lit("no text to write"))).alias("error"),
        "certificate",
    )
    rows = snapshot_rows(rows)
    if others is not None:
        carried = passthrough(others, operations).select("project_id", "path", "content")
        told = {"status": F.lit("copied"), "opportunity": F.lit(False)}
        rows = rows.unionByName(snapshot_rows(carried.withColumns(told)))
    publish_snapshot(rows, root, snapshot_id)
    return read_snapshots(operations.sparkSession, root, snapshot_id).filter("status != 'copied'")


def snapshot_rows(rows: DataFrame) -> DataFrame:
    """Rows with all columns of a snapshot; those that ``rows`` lacks are null."""
    fields = rows.sparkSession.createDataFrame([], SNAPSHOT_SCHEMA).schema
    return rows.select(*(
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ))


def publish_snapshot(rows: DataFrame, root: str, snapshot_id: int) -> None:
    """Write rows of ``SNAPSHOT_SCHEMA`` in a folder of their own, then list it in the manifest.

    Readers see the rows when the manifest has them: at the last step, one file with a row for
    each project and one for the snapshot itself. A write that fails leaves what was there
    before; so does a driver lost halfway. Of two writes at once, the one listed last stays.
    ``rebalance`` lets the engine split a huge project over several output files and pack
    small ones together.
    """
    spark = rows.sparkSession
    folder = f"snapshot_id={snapshot_id}/write=w{uuid.uuid4().hex}"
    dealt = rows.drop("snapshot_id").hint("rebalance", "project_id").sortWithinPartitions("project_id", "path")
    with passing_shuffles(spark):
        dealt.write.parquet(f"{root}/{folder}")
    version = _manifest(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    # the row of the snapshot itself lists a write without any rows, too
    stored = spark.read.schema("project_id BIGINT").parquet(f"{root}/{folder}")
    projects = stored.groupBy("project_id").agg(F.count("*").alias("files"))
    itself = spark.createDataFrame([(None, None)], "project_id BIGINT, files BIGINT")
    listed = projects.unionByName(itself).select(
        F.lit(snapshot_id).cast("int").alias("snapshot_id"), F.lit(folder).alias("folder"),
        F.lit(version).cast("bigint").alias("version"), "project_id", "files",
    )
    listed.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the manifest, superseded ones included; a root without one has none."""
    if not folder_exists(spark, f"{root}/manifest"):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest")


def published(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot_id, folder, project_id, files) of the last write of each snapshot.

    The row of a snapshot itself has null ``files``. The join is on one row a snapshot.
    """
    rows = _manifest(spark, root)
    last = rows.filter("files IS NULL").groupBy("snapshot_id").agg(
        F.max(F.struct("version", "folder"))["folder"].alias("folder")
    )
    return rows.join(last, ["snapshot_id", "folder"], "left_semi").drop("version")


def read_snapshots(spark: SparkSession, root: str, snapshot_id: int | None = None) -> DataFrame:
    """Published snapshots below ``root``, all or one.

    The driver gets the names of the folders, one for each snapshot, and no other row.
    """
    listed = published(spark, root).filter("files IS NULL")
    if snapshot_id is not None:
        listed = listed.filter(F.col("snapshot_id") == snapshot_id)
    folders = [f"{root}/{row.folder}" for row in listed.select("folder").collect()]
    if not folders:
        return spark.createDataFrame([], SNAPSHOT_SCHEMA)
    rows = spark.read.schema(SNAPSHOT_SCHEMA).option("basePath", root).parquet(*folders)
    return rows.drop("write")


def written_projects(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, snapshot_id) of published snapshots, from the manifest; no snapshot is read."""
    return published(spark, root).filter("files IS NOT NULL").select("project_id", "snapshot_id")


def restore_backup(spark: SparkSession, root: str, snapshot_id: int) -> DataFrame:
    """Publish the files of the projects' backups as the new rows of ``snapshot_id``.

    Projects without a backup become empty. Until the last step readers see the rows that
    are replaced. Returns the backup manifest afterwards: restored projects have none left.
    """
    manifest = backup_manifest(written_projects(spark, root)).filter(
        F.col("snapshot_id") == snapshot_id
    )
    restored = rollback_full(read_snapshots(spark, root), manifest)
    left = cut_lineage(consume_backup(manifest, restored))
    publish_snapshot(restored, root, snapshot_id)
    return left


def delete_unlisted(spark: SparkSession, root: str) -> int:
    """Delete folders of superseded and failed writes, and return how many.

    Call it while nobody writes below ``root`` or reads what a later write replaced.
    """
    kept = {row.folder for row in published(spark, root).filter("files IS NULL").collect()}
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot_id=*/write=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or ()
    stale = [
        status.getPath().toString() for status in found
        if "/".join(status.getPath().toString().rsplit("/", 2)[1:]) not in kept
    ]
    for uri in stale:
        delete_folder(spark, uri)
    return len(stale)


def snapshot_files(spark: SparkSession, root: str, snapshot_id: int) -> DataFrame:
    rows = read_snapshots(spark, root, snapshot_id).filter(
        F.col("status").isin("completed", "copied")
    )
    return rows.select("project_id", "snapshot_id", "path", "content")


def report_operations(operations: DataFrame) -> DataFrame:
    return operations.select(
        "project_id",
        F.col("op_id").alias("id"),
        F.col("path").alias("file"),
        "status",
        F.size("changes").alias("changes_count"),
        F.col("certificate").alias("proof_certificate"),
    )


def report_entities(entities: DataFrame) -> DataFrame:
    return entities.select(
        "project_id", "name", "module", "language", F.struct("args").alias("signature")
    )


def report_projects(projects: DataFrame, summary: DataFrame) -> DataFrame:
    """``projects`` holds project_id and the fields of ``project_info``."""
    info = F.struct("name", "source_path", "target_path", "created_at", "status", "completed_at")
    totals = F.struct(
        "total_operations", "completed_operations", "failed_operations",
        "total_confidence", "average_confidence",
    ).alias("transformation_summary")
    return projects.select("project_id", info.alias("project_info")).join(
        summary.select("project_id", totals), "project_id", "left"
    )


def write_report(
    path: str, projects: DataFrame, summary: DataFrame, operations: DataFrame,
    entities: DataFrame, compression: str = "none",
) -> str:
    """JSON lines in one folder per section; with ``compression`` gzip a seventh of the size, as certificates repeat.

    A project's operations are rows, not one array, since one project may hold a large
    share of all files.
    """
    parts = {
        "project": report_projects(projects, summary),
        "operations": report_operations(operations),
        "api_entities": report_entities(entities),
    }
    for section, rows in parts.items():
        with passing_shuffles(rows.sparkSession):
            rows.write.mode("overwrite").options(ignoreNullFields="false", compression=compression).json(f"{path}/{section}")
    return path


def read_report(spark: SparkSession, path: str, section: str) -> DataFrame:
    return spark.read.schema(SECTIONS[section]).json(f"{path}/{section}")


def scan_report(operations: DataFrame) -> DataFrame:
    """One row per proof of a report's operations; operations without proofs keep a row."""
    certificate = F.col("proof_certificate")
    return operations.select(
        "project_id", "file", "status",
        certificate["cert_id"].alias("cert_id"),
        certificate["issued_at"].alias("issued_at"),
        certificate["status"].alias("verification"),
        F.posexplode_outer(certificate["proofs"]).alias("proof_ord", "proof"),
    ).select(
        "project_id", "file", "status", "cert_id", "issued_at", "verification", "proof_ord",
        "proof.rule_name", "proof.proof_obligation", F.col("proof.confidence").alias("confidence"),
    )
