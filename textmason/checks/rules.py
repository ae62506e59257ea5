"""Rule matching, rewriting, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmason.checks import inputs as I
from textmason.checks.registry import query
from textmason.checks.scans import planned
from textmason.operators import evidence, rewrite
from textmason.operators.nodes import KEYWORDS, call_arguments, syntax_nodes
from textmason.operators import rules as R


@query("rule_catalogue", I.MATCHES_SQL + """
SELECT rule_ord AS ord, rule_name AS name, rule_type AS type, confidence, description,
       count(*) AS hits, count(DISTINCT path) AS files
FROM matches GROUP BY ALL""")
def rule_catalogue(spark, sf_dir):
    """The catalogue with its use in the corpus."""
    book = R.RuleBook()
    used = R.match_rules(I.corpus(spark, sf_dir, 1), book).groupBy("rule_name", "path").agg(
        F.count("*").alias("n")
    ).groupBy(F.col("rule_name").alias("name")).agg(
        F.sum("n").alias("hits"), F.count("*").alias("files")
    )
    catalogue = book.to_df(spark).select("ord", "name", "type", "confidence", "description")
    return catalogue.join(used, "name", "left").fillna(0, ["hits", "files"])


@query("add_rule", """
SELECT p_brand AS name, min(p_partkey) AS ord, arg_max(p_name, p_partkey) AS pattern,
       arg_max(p_type, p_partkey) AS replacement, arg_max(p_size / 50.0::DOUBLE, p_partkey)
         AS confidence
FROM part GROUP BY p_brand""")
def add_rule(spark, sf_dir):
    rules = I.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord"),
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("pattern"),
        F.col("p_type").alias("replacement"), (F.col("p_size") / 50.0).alias("confidence"),
    )
    return R.upsert_rules(rules)


@query("match_rules", I.MATCHES_SQL + """
SELECT project_id, path, rule_ord, match_ord, rule_name, matched, replacement, confidence
FROM matches""")
def match_rules(spark, sf_dir):
    return R.match_rules(I.corpus(spark, sf_dir, 1), R.RuleBook()).select(
        "project_id", "path", "rule_ord", "match_ord", "rule_name", "matched", "replacement",
        "confidence",
    )


@query("replacement_text", I.MATCHES_SQL + """
SELECT rule_name, matched, replacement, count(*) AS n FROM matches GROUP BY 1, 2, 3""")
def replacement_text(spark, sf_dir):
    """Each distinct fragment is replaced once, by its own rule."""
    book = R.RuleBook()
    fragments = R.match_rules(I.corpus(spark, sf_dir, 1), book).groupBy(
        "rule_name", "matched"
    ).agg(F.count("*").alias("n"))
    replaced = F.coalesce(*[
        F.when(F.col("rule_name") == r.name, R.replacement_text(F.col("matched"), r))
        for r in book.rules
    ])
    return fragments.withColumn("replacement", replaced)


@query("apply_match_once", I.MATCHES_SQL + """
SELECT project_id, path, rule_ord, match_ord, sha256(concat(
    substr(content, 1, instr(content, matched) - 1), replacement,
    substr(content, instr(content, matched) + length(matched)))) AS result_hash
FROM matches JOIN v1 USING (project_id, path)""")
def apply_match_once(spark, sf_dir):
    """Every single match applied by itself to its file."""
    content = F.col("content")
    hits = I.corpus(spark, sf_dir, 1).select(
        "project_id", "path", "content", F.inline(R.matches_of(content, R.RuleBook()))
    )
    result = R.apply_match_once(content, F.col("matched"), F.col("replacement"))
    return hits.select(
        "project_id", "path", "rule_ord", "match_ord", F.sha2(result, 256).alias("result_hash")
    )


def _rewrite_query(name, step, sql_steps):
    @query(name, I.FILES_SQL + f"""
SELECT project_id, snapshot_id, path,
       sha256({I.rewrite_steps_sql('content', sql_steps)}) AS result_hash FROM files""")
    def run(spark, sf_dir):
        return I.corpus(spark, sf_dir).select(
            "project_id", "snapshot_id", "path",
            F.sha2(step(F.col("content")), 256).alias("result_hash"),
        )


_rewrite_query("rewrite_scale_timeout", rewrite.scale_timeout, "1")
_rewrite_query("rewrite_payload_dumps", rewrite.payload_dumps, "2")
_rewrite_query("rewrite_self_timeout", rewrite.self_timeout, "3")
_rewrite_query("rewrite_data_kwarg", rewrite.data_keyword, "4")
_rewrite_query("rewrite_chain", rewrite.rewrite_chain, "1234")


@query("scale_keyword", I.CALL_ARGS_SQL + """
SELECT l_orderkey, l_linenumber, kw,
       CASE WHEN kw = 'timeout' AND value_kind = 'const' THEN 'expr' ELSE value_kind END
         AS value_kind,
       CASE WHEN kw = 'timeout' AND value_kind = 'const' THEN concat(value, ' * 1000')
            ELSE value END AS value FROM args""")
def scale_keyword(spark, sf_dir):
    return R.apply_patterns(I.call_args(spark, sf_dir), [R.scale_keyword("timeout", 1000)])


@query("rename_keyword", I.CALL_ARGS_SQL + """
SELECT l_orderkey, l_linenumber, CASE WHEN kw = 'data' THEN 'json' ELSE kw END AS kw,
       value_kind, value FROM args""")
def rename_keyword(spark, sf_dir):
    return R.apply_patterns(I.call_args(spark, sf_dir), [R.rename_keyword("data", "json")])


@query("add_pattern", I.CALL_ARGS_SQL + """
SELECT l_orderkey, l_linenumber, CASE WHEN kw = 'data' THEN 'json' ELSE kw END AS kw,
       CASE WHEN kw = 'timeout' THEN 'expr' ELSE value_kind END AS value_kind,
       CASE WHEN kw = 'timeout' THEN concat(value, ' * 1000')
            WHEN kw = 'headers' AND value = 'R' THEN 'None' ELSE value END AS value
FROM args""")
def add_pattern(spark, sf_dir):
    """The two default patterns and one a user supplies."""
    user = R.KeywordPattern(
        "drop_returned",
        lambda: (F.col("kw") == "headers") & (F.col("value") == "R"),
        lambda: {"value": F.lit("None")},
    )
    patterns = [R.scale_keyword("timeout", 1000), R.rename_keyword("data", "json"), user]
    return R.apply_patterns(I.call_args(spark, sf_dir), patterns)


# Calls of the three Python snippets of version 1, keyword by keyword.
@query("keyword_patterns", I.V1_SQL.replace(", v1 AS", """, calls AS (
  SELECT project_id, path, snippet, l_partkey % 3 AS kind, """ + I.QTY + """ AS qty FROM items
  WHERE snapshot_id = 1 AND path LIKE '%.py'), v1 AS""") + """
SELECT project_id, path, 'json' AS kw, 'expr' AS value_kind,
       CASE kind WHEN 0 THEN 'json.dumps(body)' ELSE 'body' END AS value
FROM calls WHERE kind <> 1
UNION ALL
SELECT project_id, path, 'timeout', 'expr',
       CASE kind WHEN 0 THEN concat(qty, ' * 1000') WHEN 1 THEN concat(qty, '0 * 1000')
                 ELSE '30 * 1000' END FROM calls""")
def keyword_patterns(spark, sf_dir):
    """The default patterns on the keyword arguments of parsed calls."""
    files = I.corpus(spark, sf_dir, 1)
    arguments = call_arguments(syntax_nodes(files, kinds=KEYWORDS, under=KEYWORDS))
    patterns = [R.scale_keyword("timeout", 1000), R.rename_keyword("data", "json")]
    return R.apply_patterns(arguments, patterns).select(
        "project_id", "path", "kw", "value_kind", "value"
    )


@query("plan_changes", I.MATCHES_SQL + """
SELECT v1.project_id, v1.path,
       coalesce(row_number() OVER (PARTITION BY v1.project_id, v1.path
                                   ORDER BY rule_ord, match_ord) - 1, 0) AS change_ord,
       coalesce(rule_type, 'api_migration') AS type,
       coalesce(description, 'Migrate API calls to new version') AS description,
       matched, replacement
FROM v1 LEFT JOIN matches USING (project_id, path)""")
def plan_changes(spark, sf_dir):
    return planned(spark, sf_dir).select(
        "project_id", "path", F.posexplode("changes").alias("change_ord", "change")
    ).select("project_id", "path", "change_ord", "change.*")


@query("plan_operations", I.MATCHES_SQL + f""",
counted AS (SELECT project_id, path, count(*) AS n FROM matches GROUP BY 1, 2)
SELECT v1.project_id, v1.path, 'pending' AS status, sha256(content) AS original_hash,
       sha256({I.rewrite_steps_sql('content')}) AS rewritten_hash,
       coalesce(n, 1) AS changes, n IS NOT NULL AS has_certificate
FROM v1 LEFT JOIN counted USING (project_id, path)""")
def plan_operations(spark, sf_dir):
    return planned(spark, sf_dir).select(
        "project_id", "path", "status", F.sha2("original", 256).alias("original_hash"),
        F.sha2("rewritten", 256).alias("rewritten_hash"), F.size("changes").alias("changes"),
        F.col("certificate").isNotNull().alias("has_certificate"),
    )


@query("certificates", I.MATCHES_SQL + f""",
per_file AS (
  SELECT project_id, path, count(*) AS proofs, avg(confidence) AS confidence
  FROM matches GROUP BY 1, 2)
SELECT project_id, path, sha256(content) AS original_sha256,
       sha256({I.rewrite_steps_sql('content')}) AS rewritten_sha256,
       CASE WHEN confidence >= 0.5 THEN 'verified' ELSE 'unverified' END AS status,
       round(confidence, 6) AS confidence, proofs
FROM per_file JOIN v1 USING (project_id, path)""")
def certificates(spark, sf_dir):
    rows = evidence.certificates(planned(spark, sf_dir))
    return rows.select(
        "project_id", "path", "original_sha256", "rewritten_sha256", "status",
        F.round("confidence", 6).alias("confidence"), F.size("proofs").alias("proofs"),
    )


@query("match_order", I.MATCHES_SQL + """
SELECT project_id, path, row_number() OVER (PARTITION BY project_id, path
         ORDER BY rule_ord, match_ord) - 1 AS proof_ord, rule_name, matched AS matched_code
FROM matches""")
def match_order(spark, sf_dir):
    """Proofs keep rule order, then position in the text."""
    return evidence.proofs(planned(spark, sf_dir)).select(
        "project_id", "path", "proof_ord", "rule_name", "matched_code"
    )


@query("confidence_mean", I.MATCHES_SQL + """
SELECT project_id, path, round(avg(confidence), 6) AS confidence FROM matches GROUP BY 1, 2""")
def confidence_mean(spark, sf_dir):
    content = F.col("content")
    mean = evidence.mean_confidence(F.col("matches"))
    return (
        I.corpus(spark, sf_dir, 1)
        .select("project_id", "path", R.matches_of(content, R.RuleBook()).alias("matches"))
        .filter(F.size("matches") > 0)
        .select("project_id", "path", F.round(mean, 6).alias("confidence"))
    )
