"""Dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmason.checks import inputs as I
from textmason.checks.registry import query
from textmason.operators import graph
from textmason.operators.nodes import IMPORTS, extract_imports, import_edges, syntax_nodes

_WITH = "WITH RECURSIVE " + I.EDGES_SQL


@query("graph_build", _WITH + """
SELECT 'vertex' AS kind, v AS src, NULL AS dst FROM (
  SELECT src AS v FROM edges UNION SELECT dst FROM edges UNION
  SELECT concat('s', cast(s_suppkey as string)) FROM supplier)
UNION ALL SELECT 'edge', src, dst FROM edges""")
def graph_build(spark, sf_dir):
    """Every edge given twice; suppliers are vertices without edges."""
    edges = I.part_edges(spark, sf_dir)
    isolated = I.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("v")
    )
    vertices, edges = graph.graph_build(edges.union(edges), isolated)
    return vertices.select(
        F.lit("vertex").alias("kind"), F.col("v").alias("src"),
        F.lit(None).cast("string").alias("dst"),
    ).union(edges.select(F.lit("edge"), "src", "dst"))


@query("graph_dependencies", _WITH + " SELECT src AS v, dst AS dependency FROM edges")
def graph_dependencies(spark, sf_dir):
    return graph.graph_dependencies(I.part_edges(spark, sf_dir))


@query("graph_dependents", _WITH + " SELECT dst AS v, src AS dependent FROM edges")
def graph_dependents(spark, sf_dir):
    return graph.graph_dependents(I.part_edges(spark, sf_dir))


_REACH_SQL = """,
walk(v, depth) AS (
  SELECT src, 0 FROM edges WHERE src NOT IN (SELECT dst FROM edges)
  UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = v)"""


@query("topological_order", _WITH + _REACH_SQL + """
SELECT v, max(depth) AS level FROM walk GROUP BY v""")
def topological_order(spark, sf_dir):
    return graph.topological_order(I.part_edges(spark, sf_dir))


@query("has_cycle", _WITH + """,
looped AS (SELECT * FROM edges
           UNION SELECT '0', cast(max(p_partkey) as string) FROM part),
reach_a(src, dst) AS (
  SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach_a r JOIN edges e ON r.dst = e.src),
reach_b(src, dst) AS (
  SELECT src, dst FROM looped
  UNION SELECT r.src, e.dst FROM reach_b r JOIN looped e ON r.dst = e.src)
SELECT 'acyclic' AS graph, count(*) > 0 AS has_cycle FROM reach_a WHERE src = dst
UNION ALL SELECT 'looped', count(*) > 0 FROM reach_b WHERE src = dst""")
def has_cycle(spark, sf_dir):
    """The part graph, and the same with an edge from its end to its start."""
    edges = I.part_edges(spark, sf_dir)
    back = I.table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("last")).select(
        F.lit("0").alias("src"), F.col("last").cast("string").alias("dst")
    )
    rows = [
        ("acyclic", graph.has_cycle(edges)),
        ("looped", graph.has_cycle(edges.union(back))),
    ]
    return spark.createDataFrame(rows, "graph STRING, has_cycle BOOLEAN")


# A file for each part, in packages below src/; some packages are an __init__.py.
_MODULE = "concat('p', cast({0} % 7 as string), '.m', cast({0} as string))"
_FILE = """concat('src/p', cast({0} % 7 as string), '/m', cast({0} as string),
  CASE WHEN {0} % 4 = 0 THEN '/__init__.py' ELSE '.py' END)"""
_TEXT = f"""concat('import os, ', {_MODULE.format('(p_partkey div 2)')}, chr(10),
  'from ', {_MODULE.format('(p_partkey div 3)')}, '.inner import thing', chr(10), 'import p1', chr(10),
  'import ', {_MODULE.format('p_partkey')}, '.own', chr(10))"""


def _modules(spark, sf_dir):
    # A small file of keys becomes much text: dealt, so that not one task parses it all.
    return I.table(spark, sf_dir, "part").repartition("p_partkey").select(
        (F.col("p_partkey") * 0).alias("project_id"), F.lit(1).alias("snapshot_id"),
        F.expr(_FILE.format("p_partkey")).alias("path"), F.expr(_TEXT).alias("content"),
    )


_IMPORTS_SQL = f"""WITH RECURSIVE edges AS MATERIALIZED (
  SELECT DISTINCT {_FILE.format('p_partkey')} AS src, {_FILE.format('half')} AS dst
  FROM (SELECT p_partkey, unnest([p_partkey // 2, p_partkey // 3]) AS half FROM part)
  WHERE half IN (SELECT p_partkey FROM part) AND half <> p_partkey)"""


@query("import_edges", _IMPORTS_SQL + " SELECT src, dst FROM edges")
def imports_as_edges(spark, sf_dir):
    """Imports of modules, of names in them, of libraries, of folders and of oneself."""
    files = _modules(spark, sf_dir)
    imports = extract_imports(syntax_nodes(files, kinds=IMPORTS))
    return import_edges(files, imports, roots=("src/",)).select("src", "dst")


@query("import_levels", _IMPORTS_SQL + _REACH_SQL + """
SELECT v, max(depth) AS level FROM walk GROUP BY v""")
def import_levels(spark, sf_dir):
    """Files in the order of what imports them, from their texts."""
    return graph.topological_order(imports_as_edges(spark, sf_dir))
