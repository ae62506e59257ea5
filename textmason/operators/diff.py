"""Two-version comparison of function inventories by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.functions import patterns as P
from textmason.functions.text import fill

# Keys are compared over the whole inventory of a project, so a moved file is no change.
PROJECT_SCOPE = ("project_id",)
# Option: compare the two versions of each file only.
FILE_SCOPE = ("project_id", "path")
# What ``align`` reads of a function beside its key and position.
COMPARED = ("name", "language", "args", "profile")


def entity_key(module: Column, name: Column) -> Column:
    return F.concat_ws(".", module, name)


def dedup_last_wins(
    entities: DataFrame, scope=PROJECT_SCOPE, keep: tuple[str, ...] | None = None, parts: int | None = None
) -> DataFrame:
    """One row per key: the last definition, at the position of the first.

    ``position`` orders the rows of a scope. ``keep`` names the columns that the caller reads, by
    default all. Copies of a key combine before the shuffle, unless ``parts`` deals the
    rows to so many partitions first, each of which sorts them once.
    """
    keyed = entities.withColumn("key", entity_key(F.col("module"), F.col("name")))
    here = F.struct("path", "ord")
    rest = [
        c for c in keyed.columns
        if c not in (*scope, "key", "path", "ord") and (keep is None or c in keep)
    ]
    if parts:
        keyed = keyed.select(*scope, "key", "path", "ord", *rest).repartition(parts, *scope, "key")
    return (
        keyed.groupBy(*scope, "key")
        .agg(
            F.max_by(F.struct(*rest), here).alias("last"),
            F.min(here).alias("position"),
        )
        .select(*scope, "key", "position", "last.*")
    )


def key_intersection(old: DataFrame, new: DataFrame, scope=PROJECT_SCOPE) -> DataFrame:
    """Keys in both versions; inputs hold one row per key."""
    return old.select(*scope, "key").join(new.select(*scope, "key"), [*scope, "key"], "left_semi")


def key_difference(left: DataFrame, right: DataFrame, scope=PROJECT_SCOPE) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right.select(*scope, "key"), [*scope, "key"], "left_anti")


def key_union(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.select(*keys).union(right.select(*keys)).distinct()


def align(old: DataFrame, new: DataFrame, scope=PROJECT_SCOPE) -> DataFrame:
    """Full outer join on the key: (scope, key, old, new) with one struct per side.

    Both inputs hold one row per key and come out of a grouping by it, so the join adds no
    shuffle, and every kind of difference is a filter on its result.
    """
    sides = [
        rows.select(*scope, "key", F.struct("position", *COMPARED).alias(label))
        for rows, label in ((old, "old"), (new, "new"))
    ]
    return sides[0].join(sides[1], [*scope, "key"], "full_outer")


def unmatched_old(aligned: DataFrame, scope=PROJECT_SCOPE) -> DataFrame:
    return aligned.filter(F.col("new").isNull()).select(*scope, "key", "old.*")


def unmatched_new(aligned: DataFrame, scope=PROJECT_SCOPE) -> DataFrame:
    return aligned.filter(F.col("old").isNull()).select(*scope, "key", "new.*")


def signature_count_change(aligned: DataFrame, scope=PROJECT_SCOPE) -> DataFrame:
    """Common keys whose number of parameters differs; other edits are no change."""
    return aligned.filter(F.size("old.args") != F.size("new.args")).select(
        *scope, "key",
        F.col("old.name").alias("old_name"), F.size("old.args").alias("old_count"),
        F.col("new.name").alias("new_name"), F.size("new.args").alias("new_count"),
        F.lit("count_change").alias("type"),
    )


def _diff_rows(rows: DataFrame, scope, change: str, old, new, confidence, description):
    text = lambda c: F.lit(None).cast("string") if c is None else F.col(c)
    return rows.select(
        *scope,
        F.lit(change).alias("change_type"),
        text(old).alias("old_key"),
        text(new).alias("new_key"),
        confidence.alias("confidence"),
        description.alias("description"),
    )


def diff_exact(aligned: DataFrame, scope=PROJECT_SCOPE) -> DataFrame:
    return _diff_rows(
        signature_count_change(aligned, scope), scope, "signature_changed", "key", "key",
        F.lit(P.SIGNATURE_CHANGE_CONFIDENCE),
        fill(P.SIGNATURE_SENTENCE, F.col("old_name")),
    )


def diff_renamed(renames: DataFrame, scope=PROJECT_SCOPE) -> DataFrame:
    return _diff_rows(
        renames, scope, "signature_changed", "old_key", "new_key", F.col("score"),
        fill(P.RENAME_SENTENCE, F.col("old_name"), F.col("new_name")),
    )


def diff_added(unmatched_new: DataFrame, renames: DataFrame | None = None, scope=PROJECT_SCOPE):
    left = unmatched_new
    if renames is not None:
        taken = renames.select(*scope, F.col("new_key").alias("key"))
        left = key_difference(left, taken, scope)
    return _diff_rows(
        left, scope, "function_added", None, "key", F.lit(1.0),
        fill(P.ADDED_SENTENCE, F.col("name")),
    )


def diff_removed(unmatched_old: DataFrame, renames: DataFrame | None = None, scope=PROJECT_SCOPE):
    left = unmatched_old
    if renames is not None:
        taken = renames.select(*scope, F.col("old_key").alias("key"))
        left = key_difference(left, taken, scope)
    return _diff_rows(
        left, scope, "function_removed", "key", None, F.lit(1.0),
        fill(P.REMOVED_SENTENCE, F.col("name")),
    )


def checkable_entities(entities: DataFrame) -> DataFrame:
    """Python functions not named like a constructor or entry point."""
    return entities.filter(
        (F.col("language") == "python") & ~F.col("name").isin(*P.UNCHECKED_NAMES)
    )


def signature_compat(
    aligned: DataFrame, tolerance=P.PARAMETER_TOLERANCE, scope=PROJECT_SCOPE
) -> DataFrame:
    """Whether each checkable function exists on both sides with a similar arity."""

    def params(side: str) -> Column:
        checkable = (F.col(f"{side}.language") == "python") & ~F.col(f"{side}.name").isin(
            *P.UNCHECKED_NAMES
        )
        return F.when(checkable, F.size(f"{side}.args"))

    source, target = F.col("source_params"), F.col("target_params")
    both = source.isNotNull() & target.isNotNull()
    return (
        aligned.select(
            *scope, "key", params("old").alias("source_params"), params("new").alias("target_params")
        )
        .filter(source.isNotNull() | target.isNotNull())
        .withColumns({
            "exists_in_both": both,
            "compatible": F.when(both, F.abs(source - target) <= tolerance),
        })
    )
