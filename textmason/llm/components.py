"""Connected components of an edge table, by alternating stars.

Each round joins every node's edges to the least neighbour; groups are reduced to a
minimum before they are shuffled and are never collected, so a hub of any degree is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmason.session import cut_lineage, forget


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return (
        both.filter(F.col("v") > F.col("u")).join(least, "u")
        .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node move to the least of them, the node itself too."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("least"))
    return moved.select(F.col("v").alias("u"), F.col("least").alias("v")).unionAll(
        least.select("u", F.col("least").alias("v"))
    ).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its least node.

    ``edges`` has columns ``u`` and ``v`` (numbers, in any order; loops are ignored).
    Rounds are stored in the shared folder; the caller may ``forget`` the returned table.
    """
    now = cut_lineage(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    digest = None
    while True:
        new = cut_lineage(_small(_large(now)))
        forget(now)
        now = new
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == digest:
            break
        digest = found
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    labelled = cut_lineage(members.unionAll(roots).distinct())
    forget(now)
    return labelled
