"""Inputs derived from the given tables.

The tables hold no source code, so files of code are written out of line items, in Spark
and, as ``*_SQL``, in the checking SQL. Snippet templates are shared text that both run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmason.operators.extract import functions_by_pattern

ISSUED_AT = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issued_at():
    return F.lit(ISSUED_AT).cast("timestamp")


# -- two versions of a code corpus ---------------------------------------------------

# Some files share a stem; in version 2 some are in another folder, some have another stem.
MODULE = """CASE WHEN l_orderkey % 10 = 1 THEN 'shared'
  WHEN v = 2 AND l_orderkey % 10 = 7 THEN concat('g_', cast(l_orderkey as string))
  ELSE concat('f_', cast(l_orderkey as string)) END"""
FOLDER = """CASE WHEN l_orderkey % 10 = 1 THEN concat('pkg_', cast(l_orderkey as string), '/')
  WHEN v = 2 AND l_orderkey % 10 = 3 THEN 'moved/' ELSE 'src/' END"""
EXT = "CASE WHEN l_orderkey % 4 = 3 THEN 'js' ELSE 'py' END"
FN = (
    "concat('load_', cast(l_suppkey as string), '_', cast(l_linenumber as string), "
    "CASE WHEN v = 2 AND l_partkey % 7 = 0 THEN '_v2' ELSE '' END)"
)
EXTRA = "CASE WHEN v = 2 AND l_partkey % 5 = 0 THEN ', extra' ELSE '' END"
QTY = "cast(cast(floor(l_quantity) as int) as string)"
PARAMS = f"""concat(
  CASE WHEN l_orderkey % 4 = 3 OR l_partkey % 3 = 0 THEN 'url, body'
       WHEN l_partkey % 3 = 1 THEN 'url' ELSE 'self, url, body' END, {EXTRA})"""
SNIPPET = f"""CASE
 WHEN l_orderkey % 4 = 3 THEN concat('async function ', {FN}, '(', {PARAMS},
   ') {{ return fetch("https://h.example/', cast(l_partkey as string),
   '", {{ method: "POST", timeout: ', {QTY}, ' }}); }}')
 WHEN l_partkey % 3 = 0 THEN concat('def ', {FN}, '(', {PARAMS}, '):', chr(10),
   '    return requests.post(url, data=json.dumps(body), timeout=', {QTY}, ')')
 WHEN l_partkey % 3 = 1 THEN concat('def ', {FN}, '(', {PARAMS}, '):', chr(10),
   '    return requests.get("https://h.example/', cast(l_partkey as string),
   '", timeout=', {QTY}, '0)')
 ELSE concat('def ', {FN}, '(', {PARAMS}, '):', chr(10), '    self.timeout = timeout', chr(10),
   '    return requests.put(url, data=body, timeout=30*1000)') END"""


#: Line items of one task, so that its memory does not grow with the table.
TASK_ITEMS = 500_000


def item_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for line items, or for as many rows; None if the session's own are enough.

    The count reads footers only.
    """
    rows = table(spark, sf_dir, "lineitem").count()
    if rows <= TASK_ITEMS * spark.sparkContext.defaultParallelism:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ITEMS))


def texts(
    spark, sf_dir, versions, order: list[str], snippet: str, project: str = "o_custkey % 50"
) -> DataFrame:
    """(project_id, l_orderkey, v, content): an order's snippets in each version, joined in order.

    Line items are dealt by order as numbers, before any text is made of them: all versions, their
    grouping and the join with orders use that one shuffle. A file is one row by definition.
    """
    field = r"\bl_(?!orderkey\b)\w+"
    fields = sorted({"l_partkey", *order, *re.findall(field, snippet)})
    parts = item_parts(spark, sf_dir)
    items = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", *fields)
        .repartition(*([parts] if parts else []), "l_orderkey")
        .groupBy("l_orderkey").agg(F.collect_list(F.struct(*fields)).alias("items"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        F.expr(project).alias("project_id"), "l_orderkey",
        F.explode(F.array(*[F.lit(v) for v in versions])).alias("v"), "items",
    )
    named = ", ".join(f"'{c}', x.{c}" for c in order)
    held = "v = 1 OR x.l_partkey % 11 <> 0"  # version 2 lacks some
    text = re.sub(field, lambda found: f"x.{found[0]}", snippet)
    listed = F.expr(f"array_sort(transform(filter(items, x -> {held}), x -> named_struct({named}, 'snippet', {text})))")
    return rows.filter(F.expr(f"exists(items, x -> {held})")).select(
        "project_id", "l_orderkey", "v",
        F.array_join(F.transform(listed, lambda s: s["snippet"]), "\n").alias("content"),
    )


def files(rows: DataFrame, path) -> DataFrame:
    return rows.select("project_id", F.col("v").cast("int").alias("snapshot_id"), path.alias("path"), "content")


def corpus(
    spark: SparkSession, sf_dir: str, *versions: int, project: str = "o_custkey % 50"
) -> DataFrame:
    rows = texts(spark, sf_dir, versions or (1, 2), ["l_linenumber", "l_partkey"], SNIPPET, project)
    return files(rows, F.expr(PATH))


PATH = f"concat({FOLDER}, {MODULE}, '.', {EXT})"
ITEMS_SQL = f"""items AS MATERIALIZED (
  SELECT l.*, o_custkey % 50 AS project_id, v, v AS snapshot_id,
         {PATH} AS path, {MODULE} AS module,
         {FN} AS fn, {PARAMS} AS params, {SNIPPET} AS snippet
  FROM lineitem l JOIN orders ON o_orderkey = l_orderkey CROSS JOIN (VALUES (1), (2)) t(v)
  WHERE v = 1 OR l_partkey % 11 <> 0)"""
FILES_SQL = f"""WITH {ITEMS_SQL},
files AS (
  SELECT project_id, snapshot_id, path, l_orderkey,
         string_agg(snippet, chr(10) ORDER BY l_linenumber, l_partkey, snippet) AS content
  FROM items GROUP BY project_id, snapshot_id, path, l_orderkey)"""
V1_SQL = FILES_SQL + ", v1 AS (SELECT * FROM files WHERE snapshot_id = 1)"


def rewrite_steps_sql(column: str, steps: str = "1234") -> str:
    """The rewrites without look-around: protect, replace, unprotect."""
    def sub(text, pattern, replacement):
        return f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"

    text = column
    if "1" in steps:
        text = sub(text, r"timeout=(\d+\s*\*\s*1000)", r"'timeout' || chr(1) || '\1'")
        text = sub(text, r"timeout=(0*[1-9]\d\d+)", r"'timeout' || chr(1) || '\1'")
        text = sub(text, r"timeout=0*(\d\d?)", r"'timeout' || chr(1) || '\1*1000'")
        text = f"replace({text}, 'timeout' || chr(1), 'timeout=')"
    if "2" in steps:
        text = sub(text, r"data=json\.dumps\(([^)]+)\)", r"'json=\1'")
    if "3" in steps:
        text = sub(text, r"(self\.timeout\s*=\s*timeout)(\s*\*\s*1000)?", r"'\1 * 1000'")
    if "4" in steps:
        text = sub(text, r"(requests\.(?:post|put)\([^,]+),\s*data=", r"'\1, json='")
    return text


MATCHES_SQL = V1_SQL + r""", hits AS (
  SELECT project_id, path, 0 AS rule_ord, 'requests_timeout_scale' AS rule_name,
         'parameter_scale' AS rule_type,
         'Scale timeout from seconds to milliseconds' AS description, 0.9::DOUBLE AS confidence,
         list_filter(regexp_extract_all(content, 'timeout=\d+(?:\s*\*\s*1000)?', 0),
                     lambda x: NOT regexp_matches(x, '\*\s*1000$')) AS found
  FROM v1
  UNION ALL
  SELECT project_id, path, 1, 'requests_data_to_json', 'parameter_rename',
         'Rename data parameter to json for requests', 0.85::DOUBLE,
         regexp_extract_all(content, 'data=json\.dumps\(([^)]+)\)', 0)
  FROM v1),
matches AS (
  SELECT project_id, path, rule_ord, rule_name, rule_type, description, confidence,
         i - 1 AS match_ord, found[i] AS matched,
         CASE WHEN rule_ord = 0 THEN regexp_replace(found[i], 'timeout=(\d+)', 'timeout=\1*1000')
              ELSE regexp_replace(found[i], 'data=json\.dumps\(([^)]+)\)', 'json=\1') END
           AS replacement
  FROM hits, unnest(range(1, len(found) + 1)) t(i))"""


# -- functions found by pattern in both versions -------------------------------------


def pattern_entities(files: DataFrame) -> DataFrame:
    """Functions without any parsing, for key comparisons."""
    return functions_by_pattern(files)


# JavaScript keeps the first of a name, Python all; a comparison then keeps the last.
ENTITIES_SQL = f"""WITH {ITEMS_SQL},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, snapshot_id, path
                               ORDER BY l_linenumber, l_partkey, snippet) - 1 AS position
  FROM items),
named AS (
  SELECT project_id, snapshot_id, path, module, fn AS name, position, l_partkey,
         len(string_split(params, ', ')) AS n_params,
         min(position) OVER (PARTITION BY project_id, snapshot_id, path, fn) AS first_position,
         CASE WHEN path LIKE '%.js' THEN 'javascript' ELSE 'python' END AS language,
         CASE WHEN path LIKE '%.js' THEN params
              ELSE regexp_replace(params, '^self, ', '') END AS params,
         row_number() OVER (PARTITION BY project_id, snapshot_id, path, fn ORDER BY position) AS nth
  FROM placed),
entities AS MATERIALIZED (
  SELECT *, len(string_split(params, ', ')) AS n_args, concat(module, '.', name) AS key
  FROM named WHERE language = 'python' OR nth = 1),
latest AS MATERIALIZED (
  SELECT * EXCLUDE (nth_back) FROM (
    SELECT *, row_number() OVER (of_key ORDER BY path DESC, position DESC) AS nth_back,
           min((path, position)) OVER of_key AS first_place
    FROM entities WINDOW of_key AS (PARTITION BY project_id, snapshot_id, key)) WHERE nth_back = 1),
old AS (SELECT * FROM latest WHERE snapshot_id = 1),
new AS (SELECT * FROM latest WHERE snapshot_id = 2),
paired AS MATERIALIZED (
  SELECT project_id, key, max(name) AS name, max(language) AS language,
         max(name) FILTER (snapshot_id = 1) AS old_name, max(name) FILTER (snapshot_id = 2) AS new_name,
         max(n_args) FILTER (snapshot_id = 1) AS old_count,
         max(n_args) FILTER (snapshot_id = 2) AS new_count
  FROM latest GROUP BY project_id, key)"""


# -- Python files with classes, nested functions, imports and assignments -------------

DEEP_VALUE = """CASE l_suppkey % 5 WHEN 0 THEN '5' WHEN 1 THEN concat(chr(39), 's', chr(39))
  WHEN 2 THEN '{"k": 1}' WHEN 3 THEN '[1, 2]' ELSE 'client.send(1)' END"""
_IN = "CASE WHEN l_partkey % 2 = 0 THEN '    ' ELSE '' END"
DEEP_ARGS = """CASE l_partkey % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'a0: int'
  WHEN 2 THEN 'self, a0: int, a1' ELSE 'a0: int, a1, a2' END"""
DEEP_SNIPPET = f"""concat(
  CASE l_linenumber WHEN 1 THEN concat('import mod_', cast(l_suppkey % 5 as string), ', sys', chr(10))
       WHEN 2 THEN concat('from pkg_', cast(l_suppkey % 3 as string), ' import thing', chr(10))
       WHEN 3 THEN concat('from . import other', chr(10)) ELSE '' END,
  CASE WHEN l_partkey % 2 = 0
       THEN concat('class C', cast(l_partkey % 5 as string), ':', chr(10)) ELSE '' END,
  {_IN}, 'def m_', cast(l_suppkey as string), '_', cast(l_linenumber as string), '(', {DEEP_ARGS}, '):', chr(10),
  CASE WHEN l_suppkey % 2 = 0
       THEN concat({_IN}, '    \"\"\"Doc ', {QTY}, '.\"\"\"', chr(10)) ELSE '' END,
  {_IN}, '    x', cast(l_partkey % 4 as string), ' = ', {DEEP_VALUE}, chr(10),
  CASE WHEN l_quantity > 25 THEN concat({_IN}, '    if x:', chr(10), {_IN}, '        run()', chr(10))
       WHEN l_quantity <= 10 THEN concat({_IN}, '    while x:', chr(10), {_IN}, '        break', chr(10))
       ELSE '' END,
  CASE WHEN l_partkey % 7 = 0 THEN concat({_IN}, '    def inner(q):', chr(10),
       {_IN}, '        return q', chr(10)) ELSE '' END,
  {_IN}, '    return x')"""
DEEP_BROKEN = "CASE WHEN l_orderkey % 10 = 0 THEN concat(chr(10), 'def broken(a, self):', chr(10), '    (') ELSE '' END"
_DEEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def deep_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files; those of every tenth order do not parse."""
    rows = texts(spark, sf_dir, (1,), _DEEP_ORDER, DEEP_SNIPPET)
    whole = rows.withColumn("content", F.concat("content", F.expr(DEEP_BROKEN)))
    return files(whole, F.expr("concat('lib/d_', cast(l_orderkey as string), '.py')"))


DEEP_SQL = f"""WITH deep AS (
  SELECT l.*, o_custkey % 50 AS project_id, concat('lib/d_', cast(l_orderkey as string), '.py') AS path,
         concat('m_', cast(l_suppkey as string), '_', cast(l_linenumber as string)) AS fn,
         l_partkey % 2 = 0 AS in_class, l_partkey % 7 = 0 AS has_inner,
         l_orderkey % 10 = 0 AS broken, {DEEP_ARGS} AS args, {DEEP_VALUE} AS val,
         {DEEP_SNIPPET} AS snippet,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_DEEP_ORDER)}, {DEEP_SNIPPET}) AS r
  FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
deep_files AS (
  SELECT project_id, 1 AS snapshot_id, path, l_orderkey,
         concat(string_agg(snippet, chr(10) ORDER BY r), {DEEP_BROKEN}) AS content
  FROM deep GROUP BY project_id, path, l_orderkey),
parsed AS (SELECT * FROM deep WHERE NOT broken),
defs AS (
  SELECT *, CASE WHEN in_class THEN concat('C', cast(l_partkey % 5 as string), '.', fn) ELSE fn END
           AS name, r AS place, 0 AS depth, FALSE AS is_inner FROM parsed
  UNION ALL
  SELECT *, 'inner', r, CASE WHEN in_class THEN 2 ELSE 1 END, TRUE FROM parsed WHERE has_inner)"""


# -- other derived tables --------------------------------------------------------------

# Paths of many shapes.
LISTING_PATH = """CASE o_orderkey % 8
  WHEN 0 THEN concat('repo/src/f_', cast(o_orderkey as string), '.py')
  WHEN 1 THEN concat('repo/src/a.b_', cast(o_orderkey as string), '.py')
  WHEN 2 THEN concat('repo/tests/test_', cast(o_orderkey as string), '.js')
  WHEN 3 THEN concat('repo/latest_', cast(o_orderkey as string), '.py')
  WHEN 4 THEN concat('repo/doc/d', cast(o_orderkey as string), '/.hidden')
  WHEN 5 THEN concat('repo/doc/README_', cast(o_orderkey as string))
  WHEN 6 THEN concat('repo/src/X_', cast(o_orderkey as string), '.PY')
  ELSE concat('repo/pkg_', cast(o_orderkey as string), '/__init__.py') END"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("project_id"), "o_orderkey",
        F.expr(LISTING_PATH).alias("path"),
    )


LISTING_SQL = f"""WITH listing AS (
  SELECT o_custkey % 50 AS project_id, o_orderkey, {LISTING_PATH} AS path FROM orders)"""

OUTCOME_STATUS = """CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'failed'
  WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'completed'
  ELSE 'pending' END"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations after a run, with their status only."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("project_id"),
        F.expr(LISTING_PATH).alias("path"),
        F.expr(OUTCOME_STATUS).alias("status"),
    )


OUTCOMES_SQL = f"""WITH outcomes AS (
  SELECT o_custkey % 50 AS project_id, {LISTING_PATH} AS path, {OUTCOME_STATUS} AS status
  FROM orders)"""


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One project per customer: few results each, so both outcomes occur.
    orders = table(spark, sf_dir, "orders")
    runs = F.array(
        F.struct(F.lit("source").alias("run"), (F.col("o_orderstatus") != "F").alias("success")),
        F.struct(
            F.lit("target").alias("run"), (F.col("o_orderpriority") != "1-URGENT").alias("success")
        ),
    )
    return orders.select(
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderkey").cast("string").alias("file"),
        F.inline(runs),
    )


RESULTS_SQL = """WITH results AS (
  SELECT o_custkey AS project_id, 'source' AS run, o_orderstatus <> 'F' AS success FROM orders
  UNION ALL
  SELECT o_custkey, 'target', o_orderpriority <> '1-URGENT' FROM orders),
rollup AS (
  SELECT project_id, run, count(*) AS total_files,
         count(*) FILTER (WHERE success) AS successful_tests,
         count(*) FILTER (WHERE NOT success) AS failed_tests,
         count(*) FILTER (WHERE NOT success) = 0 AS overall_success
  FROM results GROUP BY project_id, run)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part points to the one of half its key: an acyclic graph."""
    return (
        table(spark, sf_dir, "part")
        .filter("p_partkey > 0")
        .select(
            F.col("p_partkey").cast("string").alias("src"),
            F.expr("cast(p_partkey div 2 as string)").alias("dst"),
        )
    )


EDGES_SQL = """edges AS (
  SELECT DISTINCT cast(p_partkey as string) AS src, cast(p_partkey // 2 as string) AS dst
  FROM part WHERE p_partkey > 0)"""


def call_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keyword arguments per line item."""
    arg = lambda kw, kind, value: F.struct(
        F.lit(kw).alias("kw"), F.lit(kind).alias("value_kind"), value.alias("value")
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.inline(F.array(
            arg("timeout", "const", F.expr(QTY)),
            arg("data", "name", F.lit("body")),
            arg("headers", "const", F.col("l_returnflag")),
        )),
    )


CALL_ARGS_SQL = f"""WITH args AS (
  SELECT l_orderkey, l_linenumber, 'timeout' AS kw, 'const' AS value_kind, {QTY} AS value
  FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'data', 'name', 'body' FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'headers', 'const', l_returnflag FROM lineitem)"""


# -- renames of the code corpus --------------------------------------------------------
