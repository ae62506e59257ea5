"""Aggregations, limits and the whole migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmason.checks import inputs as I
from textmason.checks.registry import query
from textmason.checks.scans import planned
from textmason.functions.similarity import multiset_jaccard as jaccard
from textmason.operators import rollups
from textmason.operators.evidence import plan_operations
from textmason.operators.nodes import extract_entities
from textmason.operators.rules import RuleBook
from textmason.plans.migration import run_migration as migrate
from textmason.session import cut_lineage, fine_tasks, forget, scratch_dir
from textmason.sources import tables

_PER_FILE_SQL = I.MATCHES_SQL + """,
per_file AS (
  SELECT project_id, path, count(*) AS n, avg(confidence) AS confidence FROM matches GROUP BY 1, 2),
planned AS (SELECT v1.*, n, confidence FROM v1 LEFT JOIN per_file USING (project_id, path))"""

# JavaScript keeps one function per name, Python every one; the corpus parses as a whole.
_FOUND_SQL = """
found AS (
  SELECT project_id, count(*) AS entities FROM (
    SELECT project_id, path, fn FROM items WHERE snapshot_id = 1 AND path LIKE '%.py'
    UNION ALL
    SELECT DISTINCT project_id, path, fn FROM items WHERE snapshot_id = 1 AND path LIKE '%.js')
  GROUP BY project_id)"""


def _counted(rows):
    """The column of a table that counts by project read, stored in many tasks, as texts are parsed for it."""
    with fine_tasks(rows.sparkSession):
        return cut_lineage(rows.select("project_id"))


@query("project_analysis", I.V1_SQL + "," + _FOUND_SQL + """
SELECT project_id, count(*) AS total_files, any_value(entities) AS entities,
       any_value(entities) * 10 AS complexity_score, 'completed' AS analysis_status
FROM v1 JOIN found USING (project_id) GROUP BY project_id""")
def project_analysis(spark, sf_dir):
    files = cut_lineage(I.corpus(spark, sf_dir, 1))  # both counts read it
    return rollups.project_analysis(files, _counted(extract_entities(files)))


@query("execution_summary", I.OUTCOMES_SQL + """
SELECT project_id, count(*) AS total_operations,
       count(*) FILTER (WHERE status = 'completed') AS successful_operations,
       count(*) FILTER (WHERE status = 'failed') AS failed_operations, FALSE AS dry_run
FROM outcomes GROUP BY 1
UNION ALL
SELECT project_id, count(*), count(*), 0, TRUE FROM outcomes GROUP BY 1""")
def execution_summary(spark, sf_dir):
    operations = I.outcomes(spark, sf_dir)
    return rollups.execution_summary(operations, dry_run=False).unionByName(
        rollups.execution_summary(operations, dry_run=True)
    )


@query("report_summary", _PER_FILE_SQL + """
SELECT project_id, count(*) AS total_operations, 0 AS completed_operations,
       0 AS failed_operations, round(coalesce(sum(confidence), 0), 6) AS total_confidence,
       round(coalesce(sum(confidence), 0) / greatest(1, count(confidence)), 6)
         AS average_confidence
FROM planned GROUP BY project_id""")
def report_summary(spark, sf_dir):
    summary = rollups.report_summary(planned(spark, sf_dir))
    return summary.withColumns({
        c: F.round(c, 6) for c in ("total_confidence", "average_confidence")
    })


@query("changes_per_operation", _PER_FILE_SQL + """
SELECT project_id, path, coalesce(n, 1) AS changes_count FROM planned""")
def changes_per_operation(spark, sf_dir):
    return rollups.changes_per_operation(planned(spark, sf_dir))


_OPPORTUNITIES_SQL = r"""
opportunities AS (
  SELECT project_id, count(*) AS opportunities FROM v1
  WHERE regexp_matches(content, 'requests\.\w+\s*\(') OR regexp_matches(content, 'timeout=\d+')
     OR regexp_matches(content, 'data=json\.dumps\(') GROUP BY 1)"""


@query("run_metrics", _PER_FILE_SQL + "," + _OPPORTUNITIES_SQL + "," + _FOUND_SQL + """
SELECT project_id, coalesce(any_value(entities), 0) AS entities,
       coalesce(any_value(opportunities), 0) AS opportunities, count(*) AS operations,
       round(avg(confidence), 6) AS mean_confidence
FROM planned LEFT JOIN opportunities USING (project_id) LEFT JOIN found USING (project_id)
GROUP BY project_id""")
def run_metrics(spark, sf_dir):
    files = cut_lineage(I.corpus(spark, sf_dir, 1))  # all three tables read it
    metrics = rollups.run_metrics(
        _counted(extract_entities(files)), rollups.opportunities(files),
        plan_operations(files, RuleBook(), I.issued_at()),
    )
    return metrics.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("run_migration", _PER_FILE_SQL + "," + _OPPORTUNITIES_SQL + "," + _FOUND_SQL + f"""
SELECT project_id, count(*) AS total_files, coalesce(any_value(entities), 0) AS entities,
       coalesce(any_value(opportunities), 0) AS opportunities, count(*) AS successful_operations,
       round(coalesce(sum(confidence), 0) / greatest(1, count(confidence)), 6)
         AS average_confidence
FROM planned LEFT JOIN opportunities USING (project_id) LEFT JOIN found USING (project_id)
GROUP BY project_id""")
def run_migration(spark, sf_dir):
    """Dry run of every project."""
    run = migrate(I.corpus(spark, sf_dir, 1), I.issued_at())
    return (
        run.analysis.select("project_id", "total_files", "entities")
        .join(run.metrics.select("project_id", "opportunities"), "project_id")
        .join(run.execution.select("project_id", "successful_operations"), "project_id")
        .join(
            run.summary.select(
                "project_id", F.round("average_confidence", 6).alias("average_confidence")
            ),
            "project_id",
        )
    )


_OTHERS = """CASE WHEN o_orderkey % 2 = 0 THEN concat('docs/r_', cast(o_orderkey as string), '.md')
  ELSE concat('src/f_', cast(o_orderkey as string), '.cfg') END"""


# Twice: the second snapshot replaces the first, which its manifest names.
@query("run_migration_executed", _PER_FILE_SQL + f""",
found AS (
  SELECT project_id, module, name, count(*) AS n FROM (
    SELECT project_id, path, module, fn AS name FROM items WHERE snapshot_id = 1 AND path LIKE '%.py'
    UNION ALL
    SELECT DISTINCT project_id, path, module, fn FROM items WHERE snapshot_id = 1 AND path LIKE '%.js')
  GROUP BY ALL)
SELECT 'snapshot' AS section, project_id, path AS name,
       concat('completed ', sha256({I.rewrite_steps_sql("content")})) AS value FROM v1
UNION ALL
SELECT 'snapshot', o_custkey % 50, {_OTHERS}, concat('copied ', sha256(o_orderpriority)) FROM orders
UNION ALL
SELECT DISTINCT 'manifest', project_id, '2', '1' FROM v1
UNION ALL
SELECT 'project', project_id, concat('project ', project_id), concat(count(*), ' ', count(*))
FROM v1 GROUP BY project_id
UNION ALL
SELECT 'operations', project_id, path, concat('completed ', greatest(coalesce(n, 0), 1)) FROM planned
UNION ALL
SELECT 'api_entities', project_id, concat(module, '.', name), cast(n as string) FROM found""")
def run_migration_executed(spark, sf_dir):
    """An executing run of every project: stored files, manifest and all report sections."""
    files = cut_lineage(I.corpus(spark, sf_dir, 1))
    orders = I.table(spark, sf_dir, "orders")
    others = orders.select(
        (F.col("o_custkey") % 50).alias("project_id"), F.expr(_OTHERS).alias("path"),
        F.col("o_orderpriority").alias("content"),
    )
    nothing = F.lit(None)
    projects = files.select("project_id").distinct().select(
        "project_id", F.concat(F.lit("project "), F.col("project_id").cast("string")).alias("name"),
        nothing.cast("string").alias("source_path"), nothing.cast("string").alias("target_path"),
        I.issued_at().alias("created_at"), F.lit("done").alias("status"),
        I.issued_at().alias("completed_at"),
    )
    root, report = scratch_dir(spark, "target"), scratch_dir(spark, "report")
    run = None
    for snapshot in (1, 2):
        if run is not None:  # only the last run is read below
            forget(run.entities, run.analysis)
        run = migrate(
            files, I.issued_at(), dry_run=False, target_root=root, snapshot_id=snapshot,
            report_path=report, projects=projects, others=others, report_compression="gzip",
        )
    forget(files, run.entities, run.analysis)
    text = lambda *parts: F.concat_ws(" ", *[p.cast("string") for p in parts])
    summary = F.col("transformation_summary")
    stored = tables.read_snapshots(spark, root).filter("snapshot_id = 2")
    entities = tables.read_report(spark, report, "api_entities")
    rows = {
        "snapshot": stored.select(
            "project_id", F.col("path").alias("name"),
            text(F.col("status"), F.sha2("content", 256)).alias("value"),
        ),
        "manifest": run.manifest.select(
            "project_id", F.col("snapshot_id").cast("string").alias("name"),
            F.col("backup_snapshot_id").cast("string").alias("value"),
        ),
        "project": tables.read_report(spark, report, "project").select(
            "project_id", F.col("project_info.name").alias("name"),
            text(summary["total_operations"], summary["completed_operations"]).alias("value"),
        ),
        "operations": tables.read_report(spark, report, "operations").select(
            "project_id", F.col("file").alias("name"),
            text(F.col("status"), F.col("changes_count")).alias("value"),
        ),
        "api_entities": entities.groupBy(
            "project_id", F.concat_ws(".", "module", "name").alias("name")
        ).agg(F.count("*").cast("string").alias("value")),
    }
    return reduce(DataFrame.unionByName, [
        found.select(F.lit(section).alias("section"), "project_id", "name", "value")
        for section, found in rows.items()
    ])


@query("test_rollup", I.RESULTS_SQL + " SELECT * FROM rollup")
def test_rollup(spark, sf_dir):
    return rollups.test_rollup(I.test_results(spark, sf_dir))


@query("multiset_jaccard", """
WITH tokens AS (
  SELECT doc_id, token, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY 1, 2),
pairs AS (
  SELECT a.doc_id AS left_id, b.doc_id AS right_id
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
joined AS (
  SELECT left_id, right_id, token, n AS a, 0 AS b FROM pairs JOIN tokens ON doc_id = left_id
  UNION ALL
  SELECT left_id, right_id, token, 0, n FROM pairs JOIN tokens ON doc_id = right_id),
merged AS (
  SELECT left_id, right_id, token, sum(a) AS a, sum(b) AS b FROM joined GROUP BY 1, 2, 3)
SELECT left_id, right_id, round(sum(least(a, b)) / sum(greatest(a, b))::DOUBLE, 6) AS jaccard
FROM merged GROUP BY 1, 2""")
def multiset_jaccard(spark, sf_dir):
    """Token multisets of neighbouring documents, whole texts."""
    documents = I.table(spark, sf_dir, "documents")
    # texts are dealt by document once, whole: their tokens are counted where they are joined
    dealt = documents.select(F.col("doc_id").alias("id"), "text").filter("id IS NOT NULL").repartition("id")
    tokens = dealt.select(
        "id", F.explode(F.split("text", " ")).alias("token"), F.lit(1).cast("bigint").alias("n")
    )
    left = documents.select(F.col("doc_id").alias("left_id"))
    right = documents.select(
        (F.col("doc_id") - 1).alias("left_id"), F.col("doc_id").alias("right_id")
    )
    scored = jaccard(left.join(right, "left_id"), tokens)
    return scored.withColumn("jaccard", F.round("jaccard", 6))


@query("best_match", """
SELECT l_orderkey AS old_id,
       arg_max(new_id, (l_discount * 10, -new_ord)) AS new_id, max(l_discount * 10) AS score
FROM (SELECT *, l_partkey * 10 + l_linenumber AS new_ord,
             concat(cast(l_partkey as string), '_', cast(l_linenumber as string)) AS new_id
      FROM lineitem)
WHERE l_discount * 10 >= 0.4 GROUP BY l_orderkey""")
def best_match(spark, sf_dir):
    scores = I.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("old_id"),
        F.concat_ws("_", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("new_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("new_ord"),
        (F.col("l_discount") * 10).alias("score"),
    )
    return rollups.best_match(scores)


@query("first_pair", I.FILES_SQL + """
SELECT project_id, min(path) FILTER (WHERE snapshot_id = 1) AS source_file,
       min(path) FILTER (WHERE snapshot_id = 2) AS target_file
FROM files WHERE path LIKE '%.py' GROUP BY project_id
HAVING count(DISTINCT snapshot_id) = 2""")
def first_pair(spark, sf_dir):
    return rollups.first_pair(I.corpus(spark, sf_dir, 1), I.corpus(spark, sf_dir, 2))


@query("limit_preview", I.LISTING_SQL + """
SELECT path, greatest((SELECT count(*) FROM listing WHERE path LIKE '%.py') - 3, 0) AS more
FROM listing WHERE path LIKE '%.py' ORDER BY path LIMIT 3""")
def limit_preview(spark, sf_dir):
    return rollups.limit_preview(I.listing(spark, sf_dir))


@query("distinct_dates", """
WITH days AS (SELECT DISTINCT cast(ts AS DATE) AS day FROM events),
span AS (SELECT unnest(generate_series((SELECT min(day) FROM days), (SELECT max(day) FROM days),
                                       INTERVAL 1 DAY))::DATE AS day)
SELECT cast(day as string) AS day, days.day IS NOT NULL AS has_event
FROM span LEFT JOIN days USING (day)""")
def distinct_dates(spark, sf_dir):
    days = rollups.distinct_dates(I.table(spark, sf_dir, "events"))
    return days.select(F.col("day").cast("string").alias("day"), "has_event")


@query("events_per_day", """
SELECT cast(cast(ts AS DATE) as string) AS day, count(*) AS n FROM events GROUP BY 1""")
def events_per_day(spark, sf_dir):
    days = rollups.events_per_day(I.table(spark, sf_dir, "events"))
    return days.select(F.col("day").cast("string").alias("day"), "n")
