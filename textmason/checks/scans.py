"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmason.checks import inputs as I
from textmason.checks.registry import query
from textmason.functions.text import line_count, module_name
from textmason.operators.evidence import plan_operations
from textmason.operators.rollups import report_summary
from textmason.operators.rules import RuleBook
from textmason.operators.snapshots import backup_manifest, passthrough
from textmason.session import cut_lineage, forget, scratch_dir
from textmason.sources import files as tree
from textmason.sources import tables

# Some names start with "_" or ".", which Spark's own file sources would skip.
TREE_PATH = """CASE l_orderkey % 10
  WHEN 0 THEN replace(path, 'src/f_', 'src/_f_') WHEN 5 THEN replace(path, 'src/f_', 'src/.f_')
  WHEN 2 THEN replace(path, 'src/f_', concat('src/d', cast(l_orderkey % 7 as string), '/f_'))
  ELSE path END"""


#: Files that are on disk at once: each takes a block there, however short its text is. With some folders they
#: are what the planner lists by itself; a tree beyond that is walked by thousands of tasks.
TREE_FILES = 75_000


def _tree(spark, sf_dir, path=TREE_PATH):
    order = F.regexp_extract("path", r"_(\d+)", 1).cast("bigint")
    files = I.corpus(spark, sf_dir, 1).withColumn("l_orderkey", order)
    return files.withColumn("path", F.expr(path))


@query("scan_corpus", I.V1_SQL + f"""
SELECT {TREE_PATH} AS path, sha256(content) AS content_hash FROM v1""")
def scan_corpus(spark, sf_dir):
    """Files are dealt by path to trees of about ``TREE_FILES``; one tree at a time is written, scanned and deleted."""
    trees = -(-I.table(spark, sf_dir, "orders").count() // TREE_FILES)
    dealt = F.pmod(F.xxhash64("path"), F.lit(max(trees, 1))).cast("int")
    files = cut_lineage(_tree(spark, sf_dir).withColumn("tree", dealt), "tree")
    found = scratch_dir(spark, "found")
    for number in range(max(trees, 1)):
        root = scratch_dir(spark, "tree")
        written = tree.write_tree(files.filter(F.col("tree") == number), root)
        texts = tree.readable(tree.scan_corpus(spark, root))
        texts.select("path", F.sha2("content", 256).alias("content_hash")).write.mode("append").parquet(found)
        tree.delete_tree(written, root)
        forget(written)
    forget(files)
    return spark.read.schema("path STRING, content_hash STRING").parquet(found)


@query("scan_single_file", r"""
SELECT concat('d', cast(doc_id as string), '.txt') AS path,
       sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS content_hash
FROM documents WHERE text IS NOT NULL""")
def scan_single_file(spark, sf_dir):
    """A file for each document with its whole text, opened by its address; the suffix does not matter."""
    root = scratch_dir(spark, "single")
    files = I.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(
        F.lit(0).alias("project_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )
    written = tree.write_tree(files, root)
    paths = written.select(
        F.concat(F.lit(f"{root}/"), "path").alias("uri"), "path", F.lit(0).alias("size")
    )
    found = tree.readable(tree.read_paths(paths))
    return found.select("path", F.sha2("content", 256).alias("content_hash"))


@query("scan_files_table", r"""
SELECT doc_id % 50 AS project_id, concat(source, '/', cast(doc_id as string), '.txt') AS path,
       cast(doc_id as string) AS module,
       sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS content_hash,
       len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS lines
FROM documents""")
def scan_files_table(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = tree.files_table(documents, F.col("doc_id") % 50, path, F.col("text"))
    return files.select(
        "project_id", "path", module_name(F.col("path")).alias("module"),
        F.sha2("content", 256).alias("content_hash"), line_count(F.col("content")).alias("lines"),
    )


@query("scan_passthrough", I.LISTING_SQL + """
SELECT project_id, path FROM listing
WHERE NOT (path LIKE '%.py' OR path LIKE '%.js') AND o_orderkey % 3 <> 0""")
def scan_passthrough(spark, sf_dir):
    source = I.listing(spark, sf_dir)
    return passthrough(source, source.filter("o_orderkey % 3 = 0")).select("project_id", "path")


def planned(spark, sf_dir):
    return plan_operations(I.corpus(spark, sf_dir, 1), RuleBook(), I.issued_at())


@query("write_snapshot", I.V1_SQL + f"""
SELECT project_id, path, 3 AS snapshot_id, 'completed' AS status,
       sha256({I.rewrite_steps_sql('content')}) AS content_hash FROM v1""")
def write_snapshot(spark, sf_dir):
    root = scratch_dir(spark, "snapshots")
    tables.write_snapshot(planned(spark, sf_dir), root, 3)
    return tables.read_snapshots(spark, root).select(
        "project_id", "path", "snapshot_id", "status", F.sha2("content", 256).alias("content_hash")
    )


@query("backup_snapshot", """
WITH written AS (
  SELECT DISTINCT o_custkey % 50 AS project_id,
         cast(floor(o_totalprice / 1000) as int) AS snapshot_id FROM orders)
SELECT project_id, snapshot_id,
       lag(snapshot_id) OVER (PARTITION BY project_id ORDER BY snapshot_id) AS backup_snapshot_id
FROM written""")
def backup_snapshot(spark, sf_dir):
    written = I.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("project_id"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("snapshot_id"),
    )
    return backup_manifest(written)


@query("restore_backup", I.FILES_SQL + """
SELECT project_id, path, 2 AS snapshot_id, sha256(content) AS content_hash FROM files
WHERE snapshot_id = 1 AND project_id % 2 = 0""")
def restore_backup(spark, sf_dir):
    """Version 1 of even projects, then version 2 of all, then the backups published in its place."""
    root, versions = scratch_dir(spark, "restored"), I.corpus(spark, sf_dir)
    rows = tables.snapshot_rows(versions.withColumn("status", F.lit("completed")))
    tables.publish_snapshot(rows.filter("snapshot_id = 1 AND project_id % 2 = 0"), root, 1)
    tables.publish_snapshot(rows.filter("snapshot_id = 2"), root, 2)
    tables.restore_backup(spark, root, 2)
    return tables.read_snapshots(spark, root, 2).select(
        "project_id", "path", "snapshot_id", F.sha2("content", 256).alias("content_hash")
    )


@query("write_report", I.MATCHES_SQL + """,
per_file AS (SELECT project_id, path, avg(confidence) AS confidence FROM matches GROUP BY 1, 2)
SELECT v1.project_id, concat('project_', cast(v1.project_id as string)) AS name,
       count(*) AS total_operations, 0 AS completed_operations, 0 AS failed_operations,
       round(coalesce(sum(confidence), 0), 6) AS total_confidence,
       round(coalesce(sum(confidence), 0) / greatest(1, count(confidence)), 6)
         AS average_confidence
FROM v1 LEFT JOIN per_file USING (project_id, path) GROUP BY v1.project_id""")
def write_report(spark, sf_dir):
    files = cut_lineage(I.corpus(spark, sf_dir, 1))  # all sections read it
    operations = plan_operations(files, RuleBook(), I.issued_at())
    projects = operations.select("project_id").distinct().select(
        "project_id",
        F.concat(F.lit("project_"), F.col("project_id").cast("string")).alias("name"),
        F.lit("src").alias("source_path"), F.lit("out").alias("target_path"),
        I.issued_at().alias("created_at"), F.lit("completed").alias("status"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )
    path = tables.write_report(
        scratch_dir(spark, "report"), projects, report_summary(operations), operations, I.pattern_entities(files),
        compression="gzip",
    )
    forget(files)
    rows = tables.read_report(spark, path, "project").select(
        "project_id", "project_info.name", "transformation_summary.*"
    )
    return rows.withColumns({
        c: F.round(c, 6) for c in ("total_confidence", "average_confidence")
    })


@query("scan_report", I.MATCHES_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY rule_ord, match_ord) - 1
           AS proof_ord FROM matches)
SELECT project_id, path AS file, 'pending' AS status, proof_ord, rule_name, confidence
FROM v1 LEFT JOIN ranked USING (project_id, path)""")
def scan_report(spark, sf_dir):
    path = scratch_dir(spark, "report")
    operations = tables.report_operations(planned(spark, sf_dir))
    operations.write.json(f"{path}/operations")
    proofs = tables.scan_report(tables.read_report(spark, path, "operations"))
    return proofs.select("project_id", "file", "status", "proof_ord", "rule_name", "confidence")
