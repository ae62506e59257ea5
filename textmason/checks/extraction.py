"""Functions, API calls and syntax-based extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmason.checks import inputs as I
from textmason.checks.registry import query
from textmason.functions import patterns as P
from textmason.functions.text import line_count
from textmason.operators import extract, nodes



def _joined():
    return F.array_join(F.col("args")["name"], "|")


# -- JavaScript of three kinds, few names ----------------------------------------------

JS_SNIPPET = """CASE l_partkey % 4
  WHEN 0 THEN concat('async function f_', cast(l_suppkey % 6 as string), '(a, b = 1,) { }')
  WHEN 1 THEN concat('function f_', cast(l_suppkey % 6 as string), '( a ) { return fetch("https://h/',
       cast(l_partkey as string), '", { timeout: ', cast(l_linenumber as string), ' }); }')
  WHEN 2 THEN concat('const f_', cast(l_suppkey % 6 as string), ' = async (x, y, z) => x')
  ELSE concat('let g_', cast(l_suppkey % 6 as string), ' = async x => fetch(x, { method: 5 })') END"""


def _scripts(spark, sf_dir):
    texts = I.texts(spark, sf_dir, (1,), ["l_linenumber", "l_partkey"], JS_SNIPPET)
    return I.files(texts, F.expr("concat('web/s_', cast(l_orderkey as string), '.js')"))


SCRIPTS_SQL = f"""WITH scripts AS (
  SELECT o_custkey % 50 AS project_id, concat('web/s_', cast(l_orderkey as string), '.js') AS path,
         string_agg({JS_SNIPPET}, chr(10) ORDER BY l_linenumber, l_partkey, {JS_SNIPPET}) AS content
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey),
hits AS (
  SELECT project_id, path, 0 AS pass, i - 1 AS position,
         regexp_extract(h[i], 'function\\s+(\\w+)', 1) AS name,
         regexp_extract(h[i], '\\(([^)]*)\\)', 1) AS params
  FROM (SELECT *, regexp_extract_all(content,
          'async\\s+function\\s+\\w+\\s*\\([^)]*\\)', 0) AS h FROM scripts),
       unnest(range(1, len(h) + 1)) t(i)
  UNION ALL
  SELECT project_id, path, 1, i - 1, regexp_extract(h[i], 'function\\s+(\\w+)', 1),
         regexp_extract(h[i], '\\(([^)]*)\\)', 1)
  FROM (SELECT *, list_filter(regexp_extract_all(content,
          '(?:async\\s)?function\\s+\\w+\\s*\\([^)]*\\)', 0),
          lambda x: NOT starts_with(x, 'async')) AS h FROM scripts),
       unnest(range(1, len(h) + 1)) t(i)
  UNION ALL
  SELECT project_id, path, 2, i - 1, regexp_extract(h[i], '(?:const|let|var)\\s+(\\w+)', 1),
         regexp_extract(h[i], '\\(([^)]*)\\)', 1)
  FROM (SELECT *, regexp_extract_all(content, '(?:const|let|var)\\s+\\w+\\s*=\\s*'
          || '(?:async\\s*)?(?:\\([^)]*\\)|[^=>\\s]+)\\s*=>', 0) AS h FROM scripts),
       unnest(range(1, len(h) + 1)) t(i)),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, path, name ORDER BY pass, position) AS nth,
         list_filter(list_transform(string_split(params, ','), lambda x: trim(x)),
                     lambda x: x <> '') AS args
  FROM hits)"""


@query("js_functions", SCRIPTS_SQL + """
SELECT project_id, path, pass * 4294967296 + position AS ord, name,
       array_to_string(args, '|') AS args
FROM firsts WHERE nth = 1""")
def js_functions(spark, sf_dir):
    return extract.js_functions(_scripts(spark, sf_dir)).select(
        "project_id", "path", "ord", "name", _joined().alias("args")
    )


@query("dedup_first_wins", SCRIPTS_SQL + """
SELECT project_id, path, name, pass, position, params FROM firsts WHERE nth = 1""")
def dedup_first_wins(spark, sf_dir):
    found = extract.js_function_hits(F.col("content"))
    hits = _scripts(spark, sf_dir).select(*extract.KEYS, F.inline(found))
    kept = extract.dedup_first_wins(
        hits, (*extract.KEYS, "name"), F.struct("pass", "position")
    )
    return kept.select("project_id", "path", "name", "pass", "position", "params")


@query("js_api_usage", SCRIPTS_SQL + r""",
calls AS (
  SELECT project_id, path, i - 1 AS ord, h[i] AS call
  FROM (SELECT *, regexp_extract_all(content,
          'fetch\s*\(\s*["''`][^"''`]+["''`]\s*,\s*\{[^}]+\}', 0) AS h FROM scripts),
       unnest(range(1, len(h) + 1)) t(i))
SELECT project_id, path, ord, regexp_extract(call, '["''`]([^"''`]+)["''`]', 1) AS url,
       'GET' AS method, nullif(regexp_extract(call, 'timeout\s*:\s*(\d+)', 1), '') AS timeout
FROM calls""")
def js_api_usage(spark, sf_dir):
    return extract.js_api_usage(_scripts(spark, sf_dir)).select(
        "project_id", "path", "ord", "url", "method", F.col("kwargs")["timeout"].alias("timeout")
    )


# -- Python by pattern -------------------------------------------------------------------

_PY_HITS = I.FILES_SQL + r""",
hits AS (
  SELECT project_id, snapshot_id, path, i - 1 AS ord,
         regexp_extract(h[i], 'def\s+(\w+)', 1) AS name,
         list_filter(list_transform(
             string_split(regexp_extract(h[i], '\(([^)]*)\)', 1), ','), lambda x: trim(x)),
           lambda x: x <> '' AND x <> 'self') AS args
  FROM (SELECT *, regexp_extract_all(content, 'def\s+\w+\s*\([^)]*\):', 0) AS h FROM files),
       unnest(range(1, len(h) + 1)) t(i))"""


@query("py_functions_regex", _PY_HITS + """
SELECT project_id, snapshot_id, path, ord, name, array_to_string(args, '|') AS args FROM hits""")
def py_functions_regex(spark, sf_dir):
    return extract.py_functions_regex(I.corpus(spark, sf_dir)).select(
        "project_id", "snapshot_id", "path", "ord", "name", _joined().alias("args")
    )


@query("explode_params", _PY_HITS + """
SELECT project_id, snapshot_id, path, ord, name AS entity, i - 1 AS pos, args[i] AS param,
       'unknown' AS param_type
FROM hits, unnest(range(1, len(args) + 1)) t(i)""")
def explode_params(spark, sf_dir):
    rows = extract.explode_params(extract.py_functions_regex(I.corpus(spark, sf_dir)))
    return rows.drop("module")


_PY_CALLS = I.FILES_SQL + r""",
calls AS (
  SELECT project_id, snapshot_id, path, i - 1 AS ord, h[i] AS call
  FROM (SELECT *, regexp_extract_all(content, 'requests\.\w+\s*\([^)]*\)', 0) AS h FROM files
        WHERE path LIKE '%.py'),
       unnest(range(1, len(h) + 1)) t(i)),
usages AS (
  SELECT project_id, snapshot_id, path, ord, regexp_extract(call, 'requests\.\w+', 0) AS api_name,
         regexp_extract(call, '[''"](https?://[^''"]+)[''"]', 1) AS url,
         nullif(regexp_extract(call, 'timeout\s*=\s*(\d+)', 1), '') AS timeout
  FROM calls)"""


@query("py_api_usage", _PY_CALLS + " SELECT * FROM usages")
def py_api_usage(spark, sf_dir):
    return extract.py_api_usage(I.corpus(spark, sf_dir)).select(
        "project_id", "snapshot_id", "path", "ord", "api_name", "url",
        F.col("kwargs")["timeout"].alias("timeout"),
    )


@query("extract_api_usage", _PY_CALLS + r""",
fetches AS (
  SELECT project_id, snapshot_id, path, i - 1 AS ord, h[i] AS call
  FROM (SELECT *, regexp_extract_all(content, 'fetch\("[^"]+", \{[^}]+\}', 0) AS h FROM files
        WHERE path LIKE '%.js'),
       unnest(range(1, len(h) + 1)) t(i))
SELECT *, NULL AS method FROM usages
UNION ALL
SELECT project_id, snapshot_id, path, ord, 'fetch', regexp_extract(call, '"([^"]+)"', 1),
       regexp_extract(call, 'timeout: (\d+)', 1), 'POST' FROM fetches""")
def extract_api_usage(spark, sf_dir):
    files = I.corpus(spark, sf_dir)
    found = extract.extract_api_usage(files, "requests").unionByName(
        extract.extract_api_usage(files, "fetch")
    )
    return found.select(
        "project_id", "snapshot_id", "path", "ord", "api_name", "url", "method",
        F.col("kwargs")["timeout"].alias("timeout"),
    )


# -- syntax trees ------------------------------------------------------------------------


def deep_nodes(spark, sf_dir, kinds=None, under=()):
    return nodes.syntax_nodes(I.deep_corpus(spark, sf_dir), kinds=kinds, under=under)


@query("syntax_nodes", I.DEEP_SQL + """
SELECT project_id, path, 'FunctionDef' AS node_type,
       count(*) + count(*) FILTER (WHERE has_inner) AS n FROM parsed GROUP BY 1, 2
UNION ALL
SELECT project_id, path, 'ClassDef', count(*) FROM parsed WHERE in_class GROUP BY 1, 2
UNION ALL
SELECT project_id, path, 'arg',
       sum(len(string_split(args, ','))) + count(*) FILTER (WHERE has_inner)
FROM parsed GROUP BY 1, 2
UNION ALL
SELECT project_id, path, 'Assign', count(*) FROM parsed GROUP BY 1, 2
UNION ALL
SELECT project_id, path, 'Module', 1 FROM parsed GROUP BY 1, 2
UNION ALL
SELECT project_id, path, 'SyntaxError', 1 FROM deep WHERE broken GROUP BY 1, 2""")
def syntax_nodes(spark, sf_dir):
    """Node counts of some types per file; the whole table is built to get them."""
    kinds = ("FunctionDef", "ClassDef", "arg", "Assign", "Module", "SyntaxError")
    return (
        deep_nodes(spark, sf_dir)
        .groupBy("project_id", "path", "node_type")
        .agg(F.count("*").alias("n"))
        .filter(F.col("node_type").isin(*kinds))
    )


_ARGS_SQL = """CASE WHEN is_inner THEN 'q:unknown' ELSE CASE l_partkey % 4
  WHEN 0 THEN 'self:unknown' WHEN 1 THEN 'a0:int' WHEN 2 THEN 'self:unknown|a0:int|a1:unknown'
  ELSE 'a0:int|a1:unknown|a2:unknown' END END"""
_DOC_SQL = f"""CASE WHEN NOT is_inner AND l_suppkey % 2 = 0 THEN concat('Doc ', {I.QTY}, '.') END"""
_NTH = "row_number() OVER (PARTITION BY project_id, path ORDER BY depth, place)"


def _numbered(entities):
    typed = F.transform("args", lambda a: F.concat(a["name"], F.lit(":"), a["type"]))
    from pyspark.sql import Window

    # A window per file: the functions of one file.
    nth = F.row_number().over(Window.partitionBy("project_id", "path").orderBy("ord"))
    return entities.select(
        "project_id", "path", nth.cast("long").alias("nth"), "module", "name",
        F.array_join(typed, "|").alias("args"), "docstring",
    )


@query("py_functions_ast", I.DEEP_SQL + f"""
SELECT project_id, path, {_NTH} AS nth, concat('d_', cast(l_orderkey as string)) AS module, name,
       {_ARGS_SQL} AS args, {_DOC_SQL} AS docstring FROM defs""")
def py_functions_ast(spark, sf_dir):
    return _numbered(nodes.py_functions_ast(deep_nodes(spark, sf_dir, nodes.DEFINITIONS)))


_FALLBACK_SQL = rf"""
fallback AS (
  SELECT project_id, path, l_orderkey, i AS nth, regexp_extract(h[i], 'def\s+(\w+)', 1) AS name,
         array_to_string(list_transform(list_filter(list_transform(
             string_split(regexp_extract(h[i], '\(([^)]*)\)', 1), ','), lambda x: trim(x)),
           lambda x: x <> '' AND x <> 'self'), lambda x: concat(x, ':unknown')), '|') AS args
  FROM (SELECT *, regexp_extract_all(content, 'def\s+\w+\s*\([^)]*\):', 0) AS h
        FROM deep_files WHERE l_orderkey % 10 = 0),
       unnest(range(1, len(h) + 1)) t(i))"""
_BOTH_SQL = f"""
SELECT project_id, path, {_NTH} AS nth, concat('d_', cast(l_orderkey as string)) AS module, name,
       {_ARGS_SQL} AS args, {_DOC_SQL} AS docstring FROM defs
UNION ALL
SELECT project_id, path, nth, concat('d_', cast(l_orderkey as string)), name, args, NULL
FROM fallback"""


@query("py_functions", I.DEEP_SQL + "," + _FALLBACK_SQL + _BOTH_SQL)
def py_functions(spark, sf_dir):
    return _numbered(nodes.py_functions(deep_nodes(spark, sf_dir, nodes.DEFINITIONS)))


@query("extract_entities", I.DEEP_SQL + "," + _FALLBACK_SQL + "," + SCRIPTS_SQL[5:] + _BOTH_SQL + """
UNION ALL
SELECT project_id, path,
       row_number() OVER (PARTITION BY project_id, path ORDER BY pass, position),
       regexp_extract(path, 's_[0-9]+'), name,
       array_to_string(list_transform(args, lambda x: concat(x, ':unknown')), '|'), NULL
FROM firsts WHERE nth = 1
  AND EXISTS (SELECT 1 FROM scripts s WHERE s.path = firsts.path
              AND (contains(s.content, 'fetch(') OR regexp_matches(s.content, '\\bfunction\\s')))""")
def extract_entities(spark, sf_dir):
    """Python and JavaScript files together; scripts of arrows alone have no known language."""
    files = I.deep_corpus(spark, sf_dir).unionByName(_scripts(spark, sf_dir))
    return _numbered(nodes.extract_entities(files))


@query("node_profile", I.DEEP_SQL + """,
counts AS (
  SELECT project_id, path, r, is_inner, unnest(CASE WHEN is_inner
    THEN ['FunctionDef', 'arguments', 'arg', 'Return']
    ELSE list_concat(
      ['FunctionDef', 'arguments', 'Assign', 'Return'],
      list_transform(string_split(args, ','), lambda x: 'arg'),
      CASE WHEN l_suppkey % 2 = 0 THEN ['Expr', 'Constant'] ELSE [] END,
      CASE l_suppkey % 5 WHEN 2 THEN ['Dict', 'Constant', 'Constant']
        WHEN 3 THEN ['List', 'Constant', 'Constant'] WHEN 4 THEN ['Call', 'Attribute', 'Constant']
        ELSE ['Constant'] END,
      CASE WHEN l_quantity > 25 THEN ['If', 'Expr', 'Call']
        WHEN l_quantity <= 10 THEN ['While', 'Break'] ELSE [] END,
      CASE WHEN has_inner THEN ['FunctionDef', 'arguments', 'arg', 'Return'] ELSE [] END)
    END) AS node_type
  FROM defs),
per_def AS (
  SELECT project_id, path, r, is_inner, node_type, count(*) AS n FROM counts GROUP BY ALL)
SELECT project_id, path, node_type, n, count(*) AS functions FROM per_def GROUP BY 1, 2, 3, 4""")
def node_profile(spark, sf_dir):
    """How many functions of each file have n nodes of a type."""
    return (
        nodes.node_profile(deep_nodes(spark, sf_dir, nodes.DEFINITIONS))
        .groupBy("project_id", "path", "node_type", "n")
        .agg(F.count("*").alias("functions"))
    )


@query("extract_imports", I.DEEP_SQL + """
SELECT project_id, path, concat('mod_', cast(l_suppkey % 5 as string)) AS imported
FROM parsed WHERE l_linenumber = 1
UNION ALL SELECT project_id, path, 'sys' FROM parsed WHERE l_linenumber = 1
UNION ALL SELECT project_id, path, concat('pkg_', cast(l_suppkey % 3 as string))
FROM parsed WHERE l_linenumber = 2""")
def extract_imports(spark, sf_dir):
    return nodes.extract_imports(deep_nodes(spark, sf_dir, nodes.IMPORTS)).select(
        "project_id", "path", "imported"
    )


@query("extract_calls", I.DEEP_SQL + """
SELECT project_id, path, 'client.send' AS called FROM parsed WHERE l_suppkey % 5 = 4
UNION ALL SELECT project_id, path, 'run' FROM parsed WHERE l_quantity > 25""")
def extract_calls(spark, sf_dir):
    return nodes.extract_calls(deep_nodes(spark, sf_dir, nodes.CALLS)).select("project_id", "path", "called")


_TYPES_SQL = """
types AS (
  SELECT project_id, path, concat('x', cast(l_partkey % 4 as string)) AS variable,
         arg_max(CASE l_suppkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'str' WHEN 2 THEN 'dict'
                   WHEN 3 THEN 'list' ELSE 'client.send' END,
                 r + CASE WHEN in_class THEN 1000000 ELSE 0 END) AS var_type
  FROM parsed GROUP BY 1, 2, 3)"""


@query("infer_variable_types", I.DEEP_SQL + "," + _TYPES_SQL + " SELECT * FROM types")
def infer_variable_types(spark, sf_dir):
    return nodes.infer_variable_types(
        deep_nodes(spark, sf_dir, (), nodes.ASSIGNED)
    ).drop("snapshot_id")


@query("extract_control_flow", I.DEEP_SQL + """
SELECT project_id, path, CASE WHEN l_quantity > 25 THEN 'If' ELSE 'While' END AS construct
FROM parsed WHERE l_quantity > 25 OR l_quantity <= 10""")
def extract_control_flow(spark, sf_dir):
    return nodes.extract_control_flow(
        deep_nodes(spark, sf_dir, P.CONTROL_FLOW_NODES)
    ).select(
        "project_id", "path", "construct"
    )


@query("semantic_context", I.DEEP_SQL + "," + _TYPES_SQL + """,
events AS (
  SELECT project_id, path, 'call' AS kind, 3 + in_class::INT AS depth, r, 0 AS pos,
         'client.send' AS value FROM parsed WHERE l_suppkey % 5 = 4
  UNION ALL SELECT project_id, path, 'call', 4 + in_class::INT, r, 0, 'run'
  FROM parsed WHERE l_quantity > 25
  UNION ALL SELECT project_id, path, 'flow', 2 + in_class::INT, r, 0,
         CASE WHEN l_quantity > 25 THEN 'If' ELSE 'While' END
  FROM parsed WHERE l_quantity > 25 OR l_quantity <= 10
  UNION ALL SELECT project_id, path, 'import', 1, r, 0,
         concat('mod_', cast(l_suppkey % 5 as string)) FROM parsed WHERE l_linenumber = 1
  UNION ALL SELECT project_id, path, 'import', 1, r, 1, 'sys' FROM parsed WHERE l_linenumber = 1
  UNION ALL SELECT project_id, path, 'import', 1, r, 0,
         concat('pkg_', cast(l_suppkey % 3 as string)) FROM parsed WHERE l_linenumber = 2),
lists AS (
  SELECT project_id, path, kind, string_agg(value, '|' ORDER BY depth, r, pos) AS listed
  FROM events GROUP BY 1, 2, 3),
maps AS (
  SELECT project_id, path, string_agg(concat(variable, '=', var_type), '|' ORDER BY variable) AS m
  FROM types GROUP BY 1, 2)
SELECT f.project_id, f.path, coalesce(m, '') AS variable_types,
       coalesce(c.listed, '') AS function_calls, coalesce(i.listed, '') AS imports,
       coalesce(w.listed, '') AS control_flow, sha256(trim(content)) AS text_hash
FROM deep_files f
LEFT JOIN maps ON maps.path = f.path
LEFT JOIN lists c ON c.path = f.path AND c.kind = 'call'
LEFT JOIN lists i ON i.path = f.path AND i.kind = 'import'
LEFT JOIN lists w ON w.path = f.path AND w.kind = 'flow'
WHERE l_orderkey % 10 <> 0""")
def semantic_context(spark, sf_dir):
    files = I.deep_corpus(spark, sf_dir)
    context = nodes.semantic_context(
        files, nodes.syntax_nodes(files, kinds=nodes.CONTEXT, under=nodes.ASSIGNED)
    )
    typed = F.transform(
        F.map_entries("variable_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return context.select(
        "project_id", "path", F.array_join(F.array_sort(typed), "|").alias("variable_types"),
        F.array_join("function_calls", "|").alias("function_calls"),
        F.array_join("imports", "|").alias("imports"),
        F.array_join("control_flow", "|").alias("control_flow"),
        F.sha2("surrounding_code", 256).alias("text_hash"),
    )


@query("line_counts", I.V1_SQL + f"""
SELECT project_id, path, len(string_split(content, chr(10))) AS original_lines,
       len(string_split({I.rewrite_steps_sql('content')}, chr(10))) AS rewritten_lines FROM v1""")
def line_counts(spark, sf_dir):
    from textmason.operators.rewrite import rewrite_chain

    content = F.col("content")
    return I.corpus(spark, sf_dir, 1).select(
        "project_id", "path", line_count(content).alias("original_lines"),
        line_count(rewrite_chain(content)).alias("rewritten_lines"),
    )
