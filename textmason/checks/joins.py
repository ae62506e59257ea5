"""Comparison of two versions, rollback, outcome comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmason.checks import inputs as I
from textmason.checks.registry import query
from textmason.functions.patterns import ROLLBACK_STRATEGIES
from textmason.operators import diff, rollups, snapshots
from textmason.operators import rename
from textmason.operators.nodes import extract_entities
from textmason.plans import versions
from textmason.session import cut_lineage


def versions_by_pattern(spark, sf_dir, keep=None):
    """(old, new) functions found by pattern, one row per key."""
    parts = I.item_parts(spark, sf_dir)
    return tuple(
        diff.dedup_last_wins(I.pattern_entities(I.corpus(spark, sf_dir, v)), keep=keep, parts=parts)
        for v in (1, 2)
    )


def aligned_by_pattern(spark, sf_dir):
    return diff.align(*versions_by_pattern(spark, sf_dir, diff.COMPARED))


@query("entity_key", I.ENTITIES_SQL + """
SELECT project_id, snapshot_id, path, position, key FROM entities""")
def entity_key(spark, sf_dir):
    entities = I.pattern_entities(I.corpus(spark, sf_dir))
    return entities.select(
        "project_id", "snapshot_id", "path", F.col("ord").alias("position"),
        diff.entity_key(F.col("module"), F.col("name")).alias("key"),
    )


@query("dedup_last_wins", I.ENTITIES_SQL + """
SELECT project_id, key, snapshot_id, n_args, first_place[1] AS path, first_place[2] AS position
FROM latest""")
def dedup_last_wins(spark, sf_dir):
    old, new = versions_by_pattern(spark, sf_dir)
    return old.unionByName(new).select(
        "project_id", "key", "snapshot_id", F.size("args").alias("n_args"),
        F.col("position.path").alias("path"), F.col("position.ord").alias("position"),
    )


_CHANGED_SQL = """
SELECT project_id, key, old_name, new_name, old_count, new_count
FROM paired WHERE old_count <> new_count"""


@query("signature_count_change", I.ENTITIES_SQL + f"""
SELECT *, 'count_change' AS type FROM ({_CHANGED_SQL})""")
def signature_count_change(spark, sf_dir):
    return diff.signature_count_change(aligned_by_pattern(spark, sf_dir))


@query("diff_exact", I.ENTITIES_SQL + f"""
SELECT project_id, 'signature_changed' AS change_type, key AS old_key, key AS new_key,
       0.9::DOUBLE AS confidence, concat('Signature of ', old_name, ' changed') AS description
FROM ({_CHANGED_SQL})""")
def diff_exact(spark, sf_dir):
    return diff.diff_exact(aligned_by_pattern(spark, sf_dir))


@query("key_intersection", I.ENTITIES_SQL + """
SELECT project_id, key FROM old INTERSECT SELECT project_id, key FROM new""")
def key_intersection(spark, sf_dir):
    return diff.key_intersection(*versions_by_pattern(spark, sf_dir))


@query("key_union", I.ENTITIES_SQL + """
SELECT project_id, key FROM old UNION SELECT project_id, key FROM new""")
def key_union(spark, sf_dir):
    return diff.key_union(*versions_by_pattern(spark, sf_dir), ("project_id", "key"))


def _difference_sql(left, right):
    return f"""SELECT project_id, key FROM {left} EXCEPT SELECT project_id, key FROM {right}"""


@query("key_difference", I.ENTITIES_SQL + f"""
SELECT *, 'old' AS side FROM ({_difference_sql('old', 'new')})
UNION ALL SELECT *, 'new' AS side FROM ({_difference_sql('new', 'old')})""")
def key_difference(spark, sf_dir):
    old, new = versions_by_pattern(spark, sf_dir)
    sides = [
        diff.key_difference(a, b).select("project_id", "key", F.lit(name).alias("side"))
        for a, b, name in ((old, new, "old"), (new, old, "new"))
    ]
    return sides[0].unionByName(sides[1])


@query("unmatched_old", I.ENTITIES_SQL + _difference_sql("old", "new"))
def unmatched_old(spark, sf_dir):
    return diff.unmatched_old(aligned_by_pattern(spark, sf_dir)).select("project_id", "key")


@query("unmatched_new", I.ENTITIES_SQL + _difference_sql("new", "old"))
def unmatched_new(spark, sf_dir):
    return diff.unmatched_new(aligned_by_pattern(spark, sf_dir)).select("project_id", "key")


def _leftover_sql(change, missing, old_key, new_key, verb):
    return f"""
SELECT project_id, '{change}' AS change_type, {old_key} AS old_key, {new_key} AS new_key,
       1.0::DOUBLE AS confidence, concat('Function ', name, ' was {verb}') AS description
FROM paired WHERE {missing} IS NULL"""


@query("diff_added", I.ENTITIES_SQL + _leftover_sql("function_added", "old_name", "NULL", "key", "added"))
def diff_added(spark, sf_dir):
    """Exact keys only: no rename matching."""
    return diff.diff_added(diff.unmatched_new(aligned_by_pattern(spark, sf_dir)))


@query("diff_removed",
       I.ENTITIES_SQL + _leftover_sql("function_removed", "new_name", "key", "NULL", "removed"))
def diff_removed(spark, sf_dir):
    """Exact keys only: no rename matching."""
    return diff.diff_removed(diff.unmatched_old(aligned_by_pattern(spark, sf_dir)))


def _unmatched_by_tree(spark, sf_dir):
    """Functions with their syntax profiles on one side only."""
    aligned = cut_lineage(diff.align(*[
        diff.dedup_last_wins(extract_entities(I.corpus(spark, sf_dir, v)).drop("docstring"))
        for v in (1, 2)
    ]))
    return diff.unmatched_old(aligned), diff.unmatched_new(aligned)


@query("rename_candidates")
def rename_candidates(spark, sf_dir):
    """Every pair that reaches the threshold of a rename: nearly all pairs of a project."""
    found = rename.rename_candidates(*_unmatched_by_tree(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


# SQL goes by pairs and steps, too slow for projects of this size: the tests compare the five queries
# on renames with a plain statement of the matching, and with that SQL on small projects.
@query("rename_match")
def rename_match(spark, sf_dir):
    found = rename.rename_match(*_unmatched_by_tree(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


@query("rename_match_in_rounds")
def rename_match_in_rounds(spark, sf_dir):
    """The same the way that larger projects take: rounds of blocks of functions."""
    found = rename.rename_match(*_unmatched_by_tree(spark, sf_dir), scope_pairs=0)
    return found.withColumn("score", F.round("score", 6))


@query("diff_versions")
def diff_versions(spark, sf_dir):
    old, new = versions.extract_versions(*(I.corpus(spark, sf_dir, v) for v in (1, 2)))
    found = versions.diff_versions(old, new)
    return found.withColumn("confidence", F.round("confidence", 6))


@query("name_similarity")
def name_similarity(spark, sf_dir):
    """Names that left a project beside like ones that came to it."""
    found = rename.name_similarity(*_unmatched_by_tree(spark, sf_dir), floor=0.9)
    return found.withColumn("score", F.round("score", 6))


@query("signature_compat", I.ENTITIES_SQL + """
SELECT project_id, key, old_count AS source_params, new_count AS target_params,
       old_count IS NOT NULL AND new_count IS NOT NULL AS exists_in_both,
       abs(old_count - new_count) <= 2 AS compatible
FROM (SELECT project_id, key, max(n_args) FILTER (snapshot_id = 1) AS old_count,
             max(n_args) FILTER (snapshot_id = 2) AS new_count
      FROM latest WHERE language = 'python' GROUP BY project_id, key)""")
def signature_compat(spark, sf_dir):
    return diff.signature_compat(aligned_by_pattern(spark, sf_dir))


@query("compare_outcomes", I.RESULTS_SQL + """
SELECT project_id, coalesce(s.overall_success, FALSE) AS source_success,
       coalesce(t.overall_success, FALSE) AS target_success,
       coalesce(s.overall_success, FALSE) = coalesce(t.overall_success, FALSE) AS equivalent,
       CASE WHEN coalesce(s.overall_success, FALSE) = coalesce(t.overall_success, FALSE)
            THEN 'Test success status matches' ELSE 'Test success status differs' END AS note
FROM (SELECT * FROM rollup WHERE run = 'source') s
FULL JOIN (SELECT * FROM rollup WHERE run = 'target') t USING (project_id)""")
def compare_outcomes(spark, sf_dir):
    rollup = rollups.test_rollup(I.test_results(spark, sf_dir))
    return rollups.compare_outcomes(
        rollup.filter("run = 'source'"), rollup.filter("run = 'target'")
    )


@query("rollback_partial", I.OUTCOMES_SQL + """
SELECT project_id, path FROM outcomes WHERE lower(status) <> 'failed'""")
def rollback_partial(spark, sf_dir):
    operations = I.outcomes(spark, sf_dir)
    target = operations.select("project_id", "path")
    return snapshots.rollback_partial(target, operations)


@query("rollback_full", I.FILES_SQL + """
SELECT project_id, snapshot_id, path, sha256(content) AS content_hash FROM files
WHERE snapshot_id = 1 AND project_id % 2 = 0""")
def rollback_full(spark, sf_dir):
    """Even projects have version 1 as backup of version 2; odd ones have none."""
    files = I.corpus(spark, sf_dir)
    manifest = I.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("project_id"), F.lit(2).alias("snapshot_id")
    ).distinct().withColumn(
        "backup_snapshot_id", F.when(F.col("project_id") % 2 == 0, 1)
    )
    return snapshots.rollback_full(files, manifest).select(
        "project_id", "snapshot_id", "path", F.sha2("content", 256).alias("content_hash")
    )


_FAILED = "CASE WHEN length(content) % 3 = 0 THEN 'FAILED' ELSE 'completed' END"


@query("rollback_strategies", I.FILES_SQL + f"""
SELECT 'full_rollback' AS strategy, project_id, snapshot_id, path FROM files
WHERE snapshot_id = 1 AND project_id % 2 = 0
UNION ALL
SELECT 'partial_rollback', project_id, snapshot_id, path FROM files
WHERE snapshot_id = 2 AND {_FAILED} <> 'FAILED'
UNION ALL
SELECT strategy, project_id, snapshot_id, path
FROM files, (VALUES ('manual_verification'), ('selective_rollback')) s(strategy) WHERE snapshot_id = 2
UNION ALL
SELECT DISTINCT 'backups left', project_id, 2, NULL FROM files WHERE FALSE""")
def rollback_strategies(spark, sf_dir):
    """Version 2 rolled back by each strategy; a full one leaves no backup behind."""
    files = I.corpus(spark, sf_dir)
    operations = files.filter("snapshot_id = 2").select(
        "project_id", "path", F.expr(_FAILED).alias("status")
    )
    manifest = files.select("project_id").distinct().select(
        "project_id", F.lit(2).alias("snapshot_id"),
        F.when(F.col("project_id") % 2 == 0, 1).alias("backup_snapshot_id"),
    )
    found = [
        snapshots.rollback(strategy, files, 2, manifest, operations)
        .select(F.lit(strategy).alias("strategy"), "project_id", "snapshot_id", "path")
        for strategy in ROLLBACK_STRATEGIES
    ]
    left = snapshots.consume_backup(manifest, snapshots.rollback_full(files, manifest)).filter(
        "backup_snapshot_id IS NOT NULL"
    ).select(
        F.lit("backups left").alias("strategy"), "project_id", "snapshot_id",
        F.lit(None).cast("string").alias("path"),
    )
    return reduce(DataFrame.unionByName, [*found, left])
