"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmason.checks import inputs as I
from textmason.checks.registry import query
from textmason.checks.scans import planned
from textmason.functions import text
from textmason.operators import rollups
from textmason.operators.diff import checkable_entities as checkable
from textmason.operators.rules import split_by_confidence
from textmason.operators.snapshots import failed_operations as failed

_NAME = "regexp_extract(path, '[^/]*$')"


@query("module_name", I.LISTING_SQL + rf"""
SELECT path, regexp_replace({_NAME}, '^(.+)\.[^.]+$', '\1') AS module FROM listing""")
def module_name(spark, sf_dir):
    return I.listing(spark, sf_dir).select(
        "path", text.module_name(F.col("path")).alias("module")
    )


@query("relative_path", I.LISTING_SQL + rf"""
SELECT path, substr(path, 6) AS relative, {_NAME} AS single FROM listing""")
def relative_path(spark, sf_dir):
    path = F.col("path")
    return I.listing(spark, sf_dir).select(
        "path", text.relative_path(path, "repo/").alias("relative"),
        text.relative_path(path, "repo", file_mode=True).alias("single"),
    )


@query("is_code_file", I.LISTING_SQL + """
SELECT path, path LIKE '%.py' OR path LIKE '%.js' AS is_code FROM listing""")
def is_code_file(spark, sf_dir):
    return I.listing(spark, sf_dir).select(
        "path", text.is_code_file(F.col("path")).alias("is_code")
    )


@query("is_test_file", I.LISTING_SQL + rf"""
SELECT path FROM listing
WHERE (path LIKE '%.py' OR path LIKE '%.js') AND contains({_NAME}, 'test')""")
def is_test_file(spark, sf_dir):
    return I.listing(spark, sf_dir).filter(text.is_test_file(F.col("path"))).select("path")


@query("detect_language", I.FILES_SQL + r""",
texts AS (
  SELECT concat(cast(snapshot_id as string), ':', path) AS path, content FROM files
  UNION ALL SELECT concat('doc/', cast(doc_id as string)), text FROM documents
  UNION ALL SELECT concat('page/', cast(page_id as string)), html FROM pages)
SELECT path, CASE
  WHEN regexp_matches(content, '\bfunction\s+\w+\s*\(') OR contains(content, 'fetch(')
       OR contains(content, 'XMLHttpRequest') THEN 'javascript'
  WHEN regexp_matches(content, '\bdef\s+\w+\s*\(') OR contains(content, 'import ') THEN 'python'
  ELSE 'unknown' END AS language
FROM texts""")
def detect_language(spark, sf_dir):
    code = I.corpus(spark, sf_dir).select(
        F.concat_ws(":", F.col("snapshot_id").cast("string"), "path").alias("path"), "content"
    )
    for name, prefix, key, body in (
        ("documents", "doc/", "doc_id", "text"), ("pages", "page/", "page_id", "html")
    ):
        code = code.union(I.table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")), body
        ))
    return code.select("path", text.detect_language(F.col("content")).alias("language"))


# Half of the orders call another client and give no timeout.
_OTHER_CLIENT = """CASE WHEN project_id % 2 = 0 THEN
  replace(replace(content, 'requests.', 'client.'), 'timeout=', 'limit=') ELSE content END"""


def _mixed(spark, sf_dir):
    return I.corpus(spark, sf_dir, 1).withColumn("content", F.expr(_OTHER_CLIENT))


def _opportunity_sql(payload: str) -> str:
    return I.V1_SQL + rf""",
mixed AS (SELECT project_id, path, {_OTHER_CLIENT} AS content FROM v1)
SELECT project_id, regexp_extract(path, '[^/]+$') AS file, regexp_extract(path, '[^/]+$') AS entity,
       'api_migration' AS type
FROM mixed WHERE regexp_matches(content, 'requests\.\w+\s*\(')
  OR regexp_matches(content, 'timeout=\d+'){payload}"""


@query("opportunity_filter", _opportunity_sql(
    r" OR regexp_matches(content, 'data=json\.dumps\(')"))
def opportunity_filter(spark, sf_dir):
    return rollups.opportunities(_mixed(spark, sf_dir))


@query("opportunity_filter_file_mode", _opportunity_sql(""))
def opportunity_filter_file_mode(spark, sf_dir):
    return rollups.opportunities(_mixed(spark, sf_dir), include_payload=False)


@query("valid_confidence", """
SELECT p_partkey AS ord, p_name AS name, p_size / 40.0::DOUBLE AS confidence,
       p_size / 40.0::DOUBLE BETWEEN 0 AND 1 AS usable FROM part""")
def valid_confidence(spark, sf_dir):
    rules = I.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"),
        (F.col("p_size") / 40.0).alias("confidence"),
    )
    usable, quarantined = split_by_confidence(rules)
    return usable.withColumn("usable", F.lit(True)).unionByName(
        quarantined.withColumn("usable", F.lit(False))
    )


_ENTITY_NAME = """CASE l_linenumber WHEN 1 THEN 'main' WHEN 2 THEN '__init__'
  WHEN 3 THEN 'C.__init__' ELSE concat('f_', cast(l_suppkey as string)) END"""
_ENTITY_LANGUAGE = "CASE WHEN l_orderkey % 4 = 3 THEN 'javascript' ELSE 'python' END"


@query("checkable_entities", f"""
SELECT l_orderkey, {_ENTITY_NAME} AS name FROM lineitem
WHERE l_orderkey % 4 <> 3 AND l_linenumber NOT IN (1, 2)""")
def checkable_entities(spark, sf_dir):
    entities = I.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.expr(_ENTITY_NAME).alias("name"),
        F.expr(_ENTITY_LANGUAGE).alias("language"),
    )
    return checkable(entities).select("l_orderkey", "name")


@query("operations_with_evidence", I.MATCHES_SQL + """
SELECT project_id, path, count(*) AS proofs FROM matches GROUP BY 1, 2""")
def operations_with_evidence(spark, sf_dir):
    operations = planned(spark, sf_dir).filter(F.col("certificate").isNotNull())
    return operations.select(
        "project_id", "path", F.size("certificate.proofs").alias("proofs")
    )


@query("failed_operations", I.OUTCOMES_SQL + """
SELECT * FROM outcomes WHERE lower(status) = 'failed'""")
def failed_operations(spark, sf_dir):
    return failed(I.outcomes(spark, sf_dir))
