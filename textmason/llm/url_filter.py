"""URL filter: prefix rules first, then a tree of path templates per host.

The tree is grown level by level. Where a node has many children that are each seen
rarely, the segment is variable and becomes ``*``. Nodes below one node whose labelled
shares are statistically alike are merged, and a page is blocked when the smoothed share of
blocked labels of its node is high. Labels are the verdicts of the rules. The tree has as
many levels as the paths; only the name in ``template`` is cut after ``DEPTH`` levels.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed; a long path, of hundreds of segments, is followed to its end; repeated rows
count once each and get the same verdict; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.llm.common import ascii_lower, join_dealt
from textmason.session import cut_lineage

#: (host and path, verdict); a rule fits its host and all subdomains, the longest wins.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: Levels that a template names; deeper segments are written as ``**``.
DEPTH = 4
#: A segment is variable from so many children on, if each has fewer rows on average.
MANY_CHILDREN, ROWS_EACH = 8, 4
#: Shares within so many standard errors of their common share are alike.
ALIKE = 1.96
#: Smoothed share of blocked labels from which a template is blocked.
BLOCK_FROM = 0.9

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def templates(parsed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds ``parent``, ``node`` and ``template`` to rows with ``host`` and ``path``.

    Each round is stored; the next one takes only the pages that aren't at their end. Below a
    node with fewer than ``MANY_CHILDREN`` pages no segment can vary, so its pages are finished
    at once. Below a node with one child all pages go down to the next branching at once (or to
    their end on the way there), so rounds follow the branchings on a path, not its length.
    """
    columns = parsed.columns
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    length, level, rounds = F.size(parts), F.col("_level"), []
    segment, more = F.get(parts, level), length > level
    rest = F.transform(
        F.slice(parts, level + 1, F.greatest(length - level, F.lit(0))),
        lambda s: F.struct(F.lit(False).alias("end"), s.alias("segment")),
    )
    end = F.array(F.struct(F.lit(True).alias("end"), F.lit("").alias("segment")))

    def below(count):
        taken = F.slice(parts, level + 1, F.greatest(count, F.lit(0)))
        return F.concat_ws("/", F.array(F.col("node")), taken)

    rows = parsed.select(
        *columns, F.lit("").alias("parent"), F.lit("").alias("node"), F.lit(0).alias("_level")
    )
    while True:
        # the children are counted by (node, segment) first, so a hot host is pre-aggregated
        children = (
            rows.filter(more).groupBy("host", "node", segment.alias("segment"))
            # of all paths on from here: the first if an end comes last, the last if it comes first
            .agg(F.count("*").alias("n"), F.min(F.concat(rest, end)).alias("a"), F.max(rest).alias("b"))
        )
        nodes = children.groupBy("host", "node").agg(
            F.count("*").alias("children"), F.sum("n").alias("n"),
            F.min("a").alias("a"), F.max("b").alias("b"),
        )
        # both follow any path on, so they part where segments differ, or where the last one ends
        common = F.array_position(F.zip_with("a", "b", lambda a, b: a.eqNullSafe(b)), False) - 1
        nodes = nodes.select(
            "host", "node",
            ((F.col("children") >= MANY_CHILDREN)
             & (F.col("n") < ROWS_EACH * F.col("children"))).alias("_variable"),
            (F.col("n") < MANY_CHILDREN).alias("_settled"),
            F.when(F.col("children") == 1, common).otherwise(1).cast("int").alias("_common"),
        )
        left = length - level
        taken = F.when(F.col("_settled"), left).otherwise(F.least(left, F.col("_common")))
        rows = cut_lineage(
            join_dealt(rows, nodes, ["host", "node"], F.col("path"))
            .withColumn("_taken", F.when(more, taken).otherwise(0))
            .select(
                *columns,
                F.when(more, below(F.col("_taken") - 1)).otherwise(F.col("parent")).alias("parent"),
                F.when(more & F.col("_variable"), F.concat("node", F.lit("/*")))
                .when(more, below(F.col("_taken"))).otherwise(F.col("node")).alias("node"),
                (level + F.col("_taken")).alias("_level"),
                (level + F.col("_taken") >= length).alias("_done"),
            )
        )
        rounds.append(rows.stored_at)
        whole, rows = rows, rows.filter("NOT _done").drop("_done")
        if rows.isEmpty():
            break
    done = parsed.sparkSession.read.schema(whole.schema).parquet(*rounds).filter("_done")
    done = done.drop("_done", "_level")
    named = F.concat(F.array_join(F.slice(F.split("node", "/"), 1, depth + 1), "/"), F.lit("/**"))
    return done.withColumn("template", F.when(length > depth, named).otherwise(F.col("node")))


def judged(rows: DataFrame) -> DataFrame:
    """(host, node, parent, purity) from rows with ``host``, ``parent``, ``node``, ``label``."""
    counted = rows.groupBy("host", "parent", "node").agg(
        F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")
    )
    pooled = (
        counted.groupBy("host", "parent")
        .agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    )
    share = F.try_divide(F.col("all_blocked"), F.col("all_labelled"))
    # |b/n - p| <= z * sqrt(p (1 - p) / n), in a form that needs no division by n
    distance = F.abs(F.col("blocked") - share * F.col("labelled"))
    alike = (F.col("labelled") > 0) & (
        distance * distance <= ALIKE * ALIKE * share * (1 - share) * F.col("labelled")
    )
    marked = counted.join(pooled, ["host", "parent"]).withColumn(
        "branch", F.when(alike, F.lit("")).otherwise(F.col("node"))
    )
    merged = marked.groupBy("host", "parent", "branch").agg(
        F.sum("labelled").alias("n"), F.sum("blocked").alias("b")
    )
    return marked.join(merged, ["host", "parent", "branch"]).select(
        "host", "node", "parent", ((F.col("b") + 1) / (F.col("n") + 2)).alias("purity")
    )


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: host, path, rule, template, purity and verdict."""
    parsed = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"),
        host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"),
    )
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = templates(parsed.withColumn("rule", rule).withColumn("label", says))
    by_method = F.when(F.col("purity") >= BLOCK_FROM, "block").otherwise("allow")
    found = join_dealt(rows, judged(rows), ["host", "parent", "node"], F.col("path"))
    return found.select(
        "page_id", "host", "path", "rule", "template", "purity",
        F.coalesce("label", by_method).alias("verdict"),
    )


def _level_sql(level: int) -> str:
    """The same level of the tree in the checking dialect."""
    return f"""
kids{level} AS (
  SELECT host, template, parts[{level + 1}] AS segment, count(*) AS n FROM rows{level}
  WHERE len(parts) > {level} GROUP BY ALL
), variable{level} AS (
  SELECT host, template FROM kids{level} GROUP BY ALL
  HAVING count(*) >= {MANY_CHILDREN} AND sum(n) < {ROWS_EACH} * count(*)
), rows{level + 1} AS (
  SELECT r.* REPLACE (
    CASE WHEN len(parts) > {level} THEN r.template ELSE r.parent END AS parent,
    CASE WHEN len(parts) > {level} THEN r.template || '/' ||
      CASE WHEN v.host IS NOT NULL THEN '*' ELSE parts[{level + 1}] END ELSE r.template END AS template)
  FROM rows{level} r LEFT JOIN variable{level} v ON r.host = v.host AND r.template = v.template
)"""


def _fits_sql(text: str) -> str:
    host, path = text[: text.index("/")], text[text.index("/"):]
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _case_sql(value) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    return "CASE " + " ".join(f"WHEN {_fits_sql(t)} THEN '{value(t, v)}'" for t, v in ordered) + " END"


ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut
), rows0 AS (
  SELECT *, {_case_sql(lambda t, v: t)} AS rule, {_case_sql(lambda t, v: v)} AS label,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS parts, '' AS parent, '' AS template FROM parsed
), {",".join(_level_sql(level) for level in range(DEPTH))},
final AS (
  SELECT * REPLACE (CASE WHEN len(parts) > {DEPTH} THEN template || '/**' ELSE template END AS template)
  FROM rows{DEPTH}
), counted AS (
  SELECT host, parent, template, count(label) AS n, count(*) FILTER (label = 'block') AS b
  FROM final GROUP BY ALL
), pooled AS (
  SELECT *, sum(n) OVER w AS sn, sum(b) OVER w AS sb FROM counted WINDOW w AS (PARTITION BY host, parent)
), marked AS (
  SELECT *, CASE WHEN n > 0 AND pow(b - sb / sn * n, 2) <= {ALIKE * ALIKE!r} * (sb / sn) * (1 - sb / sn) * n
    THEN '' ELSE template END AS branch FROM pooled
), merged AS (
  SELECT host, parent, template, (sum(b) OVER w + 1) / (sum(n) OVER w + 2) AS purity FROM marked
  WINDOW w AS (PARTITION BY host, parent, branch)
)
SELECT f.page_id, f.host, f.path, f.rule, f.template,
  coalesce(f.label, CASE WHEN m.purity >= {BLOCK_FROM} THEN 'block' ELSE 'allow' END) AS verdict
FROM final f JOIN merged m ON f.host = m.host AND f.parent = m.parent AND f.template = m.template
"""
