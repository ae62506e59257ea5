"""Whole migration of a files table: analyse, plan, execute, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.operators.evidence import plan_operations
from textmason.operators.nodes import extract_entities
from textmason.operators.rollups import (
    execution_summary,
    project_analysis,
    report_summary,
    run_metrics,
)
from textmason.operators.rules import RuleBook
from textmason.operators.snapshots import backup_manifest
from textmason.session import Ledger, cut_lineage, fine_tasks, fingerprint, forget
from textmason.sources.files import readable
from textmason.sources.tables import write_report, write_snapshot, written_projects


@dataclass(frozen=True)
class Migration:
    """Tables of one run."""

    entities: DataFrame
    analysis: DataFrame
    operations: DataFrame
    execution: DataFrame
    summary: DataFrame
    metrics: DataFrame
    manifest: DataFrame | None = None


def select_project(files: DataFrame, project_id: int) -> DataFrame:
    """Files of one project; raises if there are none."""
    chosen = files.filter(F.col("project_id") == project_id)
    if chosen.isEmpty():
        raise ValueError(f"project {project_id} not found")
    return chosen


def run_migration(
    files: DataFrame, issued_at: Column, book: RuleBook | None = None, dry_run: bool = True,
    target_root: str | None = None, snapshot_id: int = 1, report_path: str | None = None,
    projects: DataFrame | None = None, others: DataFrame | None = None, ledger: str | None = None,
    report_compression: str = "none",
) -> Migration:
    """Run every step.

    ``files`` are the files to migrate, unreadable ones included; ``others`` are carried into
    the target unchanged. The files are stored once, read by each step, and deleted at the
    end. Parsed entities, counts and operations are stored too: operations with their texts
    in the target snapshot, or, in a dry run, without any text.

    With ``ledger``, a folder, entities, counts and operations of a dry run are kept there under keys of
    the files and of what else they depend on; a run that stopped goes on after its last whole
    stage when it is called again with the same files and parameters.
    """
    if not dry_run and target_root is None:
        raise ValueError("target_root is needed unless dry_run is set")
    files, book = cut_lineage(files), book or RuleBook()
    if ledger is None:
        stage = lambda name, build, *_: cut_lineage(build())
    else:
        kept = Ledger(files.sparkSession, ledger)
        input_key = fingerprint(files)
        stage = lambda name, build, *told: kept.stage(
            name, fingerprint(files.limit(0), input_key, *told), build
        )
    with fine_tasks(files.sparkSession):
        entities = stage("entities", lambda: extract_entities(readable(files)))
    operations = plan_operations(files, book, issued_at)
    manifest = None
    if dry_run:
        planned = operations.drop("original", "rewritten")
        operations = stage("operations", lambda: planned, book, str(issued_at))
    else:
        operations = write_snapshot(operations, target_root, snapshot_id, others)
        written = written_projects(files.sparkSession, target_root)
        manifest = backup_manifest(written).filter(F.col("snapshot_id") == snapshot_id)
    analysis = stage("analysis", lambda: project_analysis(files, entities))
    forget(files)
    summary = report_summary(operations)
    if report_path is not None:
        if projects is None:
            raise ValueError("projects are needed for a report")
        write_report(report_path, projects, summary, operations, entities, report_compression)
    return Migration(
        entities=entities,
        analysis=analysis,
        operations=operations,
        execution=execution_summary(operations, dry_run),
        summary=summary,
        metrics=run_metrics(entities, operations.filter("opportunity"), operations),
        manifest=manifest,
    )
