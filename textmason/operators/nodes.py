"""Syntax-based extraction.

``syntax_nodes`` parses each Python file once and emits its tree as flat rows. All the
other operators are relational queries over such a table. A node row repeats its
parent's type, name and visiting number and lists the function definitions around it, and
a definition's row holds its parameters and node counts, so most questions need no
self-join, none needs a range join, and the functions of a corpus need no shuffle.
"""

from __future__ import annotations

import ast
import gc
import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.functions import patterns as P
from textmason.functions.text import detect_language, module_name
from textmason.operators.extract import (
    ENTITY_COLUMNS,
    KEYS,
    first_of_each_name,
    js_functions,
    pattern_functions,
    pattern_params,
)
from textmason.session import cut_lineage

NODE_SCHEMA = (
    "project_id BIGINT, snapshot_id INT, path STRING, bfs INT, pre INT, post INT, "
    "parent_pre INT, parent_bfs INT, parent_type STRING, parent_name STRING, "
    "field STRING, pos INT, node_type STRING, name STRING, const_type STRING, text STRING, "
    "scopes ARRAY<INT>, args ARRAY<STRUCT<name: STRING, type: STRING>>, profile MAP<STRING, INT>"
)
_ARROW = pa.schema(
    [("project_id", pa.int64()), ("snapshot_id", pa.int32()), ("path", pa.string())]
    + [(c, pa.int32()) for c in ("bfs", "pre", "post", "parent_pre", "parent_bfs")]
    + [("parent_type", pa.string()), ("parent_name", pa.string())]
    + [("field", pa.string()), ("pos", pa.int32())]
    + [(c, pa.string()) for c in ("node_type", "name", "const_type", "text")]
    + [("scopes", pa.list_(pa.int32()))]
    + [("args", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])))]
    + [("profile", pa.map_(pa.string(), pa.int32()))]
)
_ROWS_PER_BATCH = 50_000
_TEXT_PER_BATCH = 32 << 20


#: Fields that never hold a syntax node.
_PLAIN_FIELDS = frozenset((
    "id", "attr", "arg", "asname", "module", "level", "kind", "type_comment", "is_async", "simple",
    "conversion", "lineno", "tag", "rest", "kwd_attrs",
))


class _Shape:
    """What to read from one syntax node type."""

    def __init__(self, kind):
        self.name = kind.__name__
        self.is_call = kind is ast.Call
        self.is_import = kind is ast.ImportFrom
        self.is_function = kind is ast.FunctionDef
        self.is_constant = kind is ast.Constant
        self.is_argument = kind is ast.arg
        self.is_keyword = kind is ast.keyword
        self.is_counted = self.name not in P.PROFILE_SKIPPED_NODES
        self.label = next((f for f in ("name", "id", "arg", "attr") if f in kind._fields), None)
        below = () if self.is_constant else kind._fields
        self.fields = tuple(f for f in reversed(below) if f not in _PLAIN_FIELDS)
        self.unmarked = tuple(f for f in self.fields if f != "ctx")
        self.is_delete = kind is ast.Delete


class _Shapes(dict):
    def __missing__(self, kind):
        shape = self[kind] = _Shape(kind)
        return shape


_shapes = _Shapes()
# Read and write marks of names say nothing an operator uses.
_MARKS = (ast.Load, ast.Store)


def _chain(node):
    """Dotted text of a name or attribute; a base that is neither adds nothing. Else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts)) if parts else None


def _label(node, shape):
    """Identifier of a node; a call's is the chain of its target."""
    if shape.is_call:
        return _chain(node.func)
    if shape.is_import:
        return node.module or None
    label = getattr(node, shape.label, None) if shape.label else None
    return label if isinstance(label, str) else None


def _source(node):
    """``ast.unparse``, which is slow for the commonest nodes."""
    if type(node) is ast.Name:
        return node.id
    if type(node) is ast.Constant and node.kind is None and type(node.value) in (int, str):
        return repr(node.value)
    return ast.unparse(node)


def _annotation(arg):
    return None if arg.annotation is None else _source(arg.annotation)


def _docstring(node):
    """``ast.get_docstring``, which is slow for the commonest text: a plain line."""
    text = ast.get_docstring(node, clean=False)
    if not text or text[0].isspace() or "\n" in text or "\t" in text:
        return text and ast.get_docstring(node)
    return text


def _text(node, shape, parent):
    if shape.is_argument:
        return _annotation(node)
    if shape.is_function:
        return _docstring(node)
    return _source(node) if parent is not None and parent.is_keyword else None


def _failed(kind, text):
    return [(0, 0, 0, None, None, None, None, None, 0, kind, None, None, text, [], None, None)]


def tree_rows(source: str, kinds=None, under=()) -> list[tuple]:
    """Rows of one file without its keys, in depth-first order; see ``syntax_nodes``."""
    try:
        root = ast.parse(source)
        return _definitions(root) if kinds == DEFINITIONS and not under else _number(root, kinds, under)
    except SyntaxError:
        return _failed("SyntaxError", source)
    except (ValueError, RecursionError, MemoryError):
        return _failed("Unparsable", None)


def _visit(root):
    """(node, parent, field, position, depth, shape) of every visit, depth first.

    Visits are numbered, not objects: the parser shares some leaf objects.
    """
    visits = []
    stack = [(root, None, None, 0, 0, _shapes[type(root)])]
    while stack:
        visit = stack.pop()
        shape = visit[5]
        if shape.fields:
            pre, node, depth = len(visits), visit[0], visit[4] + 1
            for field in shape.fields:
                value = getattr(node, field, None)
                if not value:  # most optional fields are absent
                    continue
                if value.__class__ is list:
                    for pos in range(len(value) - 1, -1, -1):
                        one = value[pos]
                        if isinstance(one, ast.AST):
                            stack.append((one, pre, field, pos, depth, _shapes[one.__class__]))
                elif isinstance(value, ast.AST) and not isinstance(value, _MARKS):
                    stack.append((value, pre, field, 0, depth, _shapes[value.__class__]))
        visits.append(visit)
    return visits


def _number(root, kinds, under) -> list[tuple]:
    visits = _visit(root)
    n = len(visits)
    if kinds is None:
        wanted = range(n)
    else:
        wanted = [
            pre for pre, visit in enumerate(visits)
            if visit[5].name in kinds or (visit[1] is not None and visits[visit[1]][5].name in under)
        ]
        if not wanted:
            return []
    # Breadth-first order is depth-first order sorted by depth.
    depths = [visit[4] for visit in visits]
    breadth_first = [0] * n
    for number, pre in enumerate(sorted(range(n), key=depths.__getitem__)):
        breadth_first[pre] = number
    last = list(range(n))
    for pre in range(n - 1, 0, -1):
        parent = visits[pre][1]
        if last[parent] < last[pre]:
            last[parent] = last[pre]
    scopes: list[list[int]] = []
    profiles: dict[int, dict[str, int]] = {}
    profiled = kinds is None or "FunctionDef" in kinds or bool(under)
    none: list[int] = []
    for pre, (_, parent, _, _, _, shape) in enumerate(visits):
        around = none if parent is None else scopes[parent]
        if shape.is_function:
            around = around + [pre]
            profiles[pre] = {}
        scopes.append(around)
        if profiled and around and shape.is_counted:
            for scope in around:
                counts = profiles[scope]
                counts[shape.name] = counts.get(shape.name, 0) + 1
    rows = []
    for pre in wanted:
        node, parent, field, pos, _, shape = visits[pre]
        args = profile = above = None
        if parent is None:
            up = (None, None, None)
        else:
            above = visits[parent][5]
            up = (breadth_first[parent], above.name, _label(visits[parent][0], above))
        if shape.is_function:
            args = [{"name": a.arg, "type": _annotation(a) or "unknown"} for a in node.args.args]
            profile = list(profiles[pre].items())
        rows.append((
            breadth_first[pre], pre, last[pre], parent, *up, field, pos, shape.name,
            _label(node, shape), type(node.value).__name__ if shape.is_constant else None,
            _text(node, shape, above), scopes[pre], args, profile,
        ))
    return rows


def _definitions(root) -> list[tuple]:
    """The rows that ``_number`` makes of functions, in one walk that keeps no other node."""
    found, around, widths = [], [], []  # functions, those open at the visited node, nodes seen by depth
    pre, deleting = 0, False  # only what is deleted has a mark that is visited
    stack = [(root, None, None, 0, 0, _shapes[type(root)])]
    while stack:
        node, parent, field, pos, depth, shape = stack.pop()
        while around and depth <= around[-1][1]:
            around.pop()[0][2] = pre - 1
        if depth == len(widths):
            widths.append(0)
        place = widths[depth]
        widths[depth] = place + 1
        if shape.is_function:
            counts: dict[str, int] = {}
            scopes = [function[0][1] for function in around] + [pre]
            function = [place, pre, pre, depth, node, parent, field, pos, scopes, counts]
            found.append(function)
            around.append((function, depth, counts))
        if around and shape.is_counted:
            name = shape.name
            for _, _, counts in around:
                counts[name] = counts.get(name, 0) + 1
        deleting = deleting or shape.is_delete
        fields = shape.fields if deleting else shape.unmarked
        if fields:
            above = (node, shape, pre, place)
            below = depth + 1
            for field in fields:
                value = getattr(node, field, None)
                if not value:
                    continue
                kind = value.__class__
                if kind is list:
                    for pos in range(len(value) - 1, -1, -1):
                        one = value[pos]
                        if isinstance(one, ast.AST):
                            stack.append((one, above, field, pos, below, _shapes[one.__class__]))
                elif kind not in _MARKS and isinstance(value, ast.AST):
                    stack.append((value, above, field, 0, below, _shapes[kind]))
        pre += 1
    if not found:
        return []
    for function, _, _ in around:
        function[2] = pre - 1
    first = [0]  # breadth-first number of the first node of each depth
    for width in widths:
        first.append(first[-1] + width)
    shape = _shapes[ast.FunctionDef]
    rows = []
    for place, number, last, depth, node, (parent, above, up, up_place), field, pos, scopes, counts in found:
        args = [{"name": a.arg, "type": _annotation(a) or "unknown"} for a in node.args.args]
        rows.append((
            first[depth] + place, number, last, up, first[depth - 1] + up_place, above.name, _label(parent, above),
            field, pos, shape.name, node.name, None, _docstring(node), scopes, args, list(counts.items()),
        ))
    return rows


def _parser(kinds=None, under=()):
    def parse(batches):
        # Trees have no cycles, and a collector that walks each new one takes a third of the time.
        collected = gc.isenabled()
        gc.disable()
        try:
            yield from parsed(batches)
        finally:
            if collected:
                gc.enable()

    def parsed(batches):
        warnings.simplefilter("ignore", SyntaxWarning)
        rows: list[tuple] = []
        keys: list[tuple] = []
        counts: list[int] = []
        read = 0

        def flush():
            file = pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), counts))
            of_file = [pa.array(c, type=f.type).take(file) for c, f in zip(zip(*keys), _ARROW)]
            of_node = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(_ARROW)[len(KEYS):])]
            return pa.RecordBatch.from_arrays(of_file + of_node, schema=_ARROW)

        for batch in batches:
            for *key, content in zip(*(c.to_pylist() for c in batch.columns)):
                found = tree_rows(content, kinds, under)
                if found:
                    rows.extend(found)
                    keys.append(tuple(key))
                    counts.append(len(found))
                read += len(content)
                if rows and (len(rows) >= _ROWS_PER_BATCH or read >= _TEXT_PER_BATCH):
                    yield flush()
                    rows.clear()
                    keys.clear()
                    counts.clear()
                    read = 0
                    gc.collect(0)
        if rows:
            yield flush()

    return parse


#: What ``py_functions`` and ``node_profile`` read.
DEFINITIONS = ("FunctionDef",)


def syntax_nodes(
    files: DataFrame, definitions_only: bool = False, kinds=None, under=()
) -> DataFrame:
    """One row per syntax node of every Python file; unparsable text gives one row.

    A reader of few rows need not be sent all: ``kinds`` leaves out all rows but those of these node
    types, of nodes right below the types ``under``, and of unparsable text. ``definitions_only``
    keeps those of functions. Rows that are kept are the same as in the whole table.
    """
    kinds = DEFINITIONS if definitions_only else kinds
    python = files.filter(detect_language(F.col("content")) == "python")
    return python.select(
        F.col("project_id").cast("bigint"), F.col("snapshot_id").cast("int"), "path", "content"
    ).mapInArrow(_parser(kinds, under), NODE_SCHEMA)


def distinct_texts(*versions: DataFrame) -> DataFrame:
    """(text_hash, content) of each distinct Python text in some files tables.

    Equal texts combine before they are shuffled.
    """
    rows = [files.select("content") for files in versions]
    python = reduce(DataFrame.unionAll, rows).filter(detect_language(F.col("content")) == "python")
    return python.groupBy(_text_hash()).agg(F.first("content").alias("content"))


def _text_hash() -> Column:
    return F.sha2("content", 256).alias("text_hash")


_OF_TEXT = [name for name in _ARROW.names if name not in KEYS]


def parse_once(*versions: DataFrame, definitions_only: bool = False) -> DataFrame:
    """Stored syntax nodes by ``text_hash``: each distinct text of all versions is parsed once."""
    texts = distinct_texts(*versions).select(
        F.lit(0).cast("bigint").alias("project_id"), F.lit(0).alias("snapshot_id"),
        F.col("text_hash").alias("path"), "content",
    )
    nodes = texts.mapInArrow(_parser(DEFINITIONS if definitions_only else None), NODE_SCHEMA)
    return cut_lineage(nodes.select(F.col("path").alias("text_hash"), *_OF_TEXT))


def nodes_of(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """The rows of ``syntax_nodes`` for files whose texts ``parse_once`` has parsed."""
    python = files.filter(detect_language(F.col("content")) == "python")
    places = python.select(
        F.col("project_id").cast("bigint"), F.col("snapshot_id").cast("int"), "path", _text_hash()
    )
    return places.join(parsed, "text_hash").select(*_ARROW.names)


def _function(ord: Column, name: Column, args: Column, doc: Column, profile: Column) -> Column:
    return F.struct(
        ord.alias("ord"), name.alias("name"), args.alias("args"), doc.alias("docstring"),
        profile.alias("profile"),
    )


def _defined() -> Column:
    """The function of a definition's row."""
    method = (F.col("parent_type") == "ClassDef") & (F.col("field") == "body")
    # A method takes its class's place in the visiting order, then its body position.
    first = F.when(method, F.col("parent_bfs")).otherwise(F.col("bfs"))
    second = F.when(method, F.col("pos")).otherwise(0)
    name = F.when(method, F.concat("parent_name", F.lit("."), "name")).otherwise(F.col("name"))
    return _function(
        first.cast("long") * (1 << 32) + second, name, F.col("args"), F.col("text"),
        F.col("profile"),
    )


def _entities(rows: DataFrame) -> DataFrame:
    return rows.select(
        *KEYS, "ord", module_name(F.col("path")).alias("module"), "name",
        F.lit("python").alias("language"), "args", "docstring", "profile",
    )


def py_functions_ast(nodes: DataFrame) -> DataFrame:
    """Functions and methods of parsed files: parameters, docstring, node profile."""
    defined = nodes.filter(F.col("node_type") == "FunctionDef")
    return _entities(defined.select(*KEYS, _defined().alias("f")).select(*KEYS, "f.*"))


def py_functions(nodes: DataFrame) -> DataFrame:
    """Tree-based functions, and pattern-based ones for text that does not parse.

    One pass: a row of unparsable text carries that text.
    """
    broken = F.col("node_type") == "SyntaxError"
    by_pattern = F.transform(
        pattern_functions(F.col("text")),
        lambda hit, position: _function(
            position.cast("long"), hit["name"], pattern_params(hit["params"]),
            F.lit(None).cast("string"), F.lit(None).cast("map<string,int>"),
        ),
    )
    kept = nodes.filter(F.col("node_type").isin("FunctionDef", "SyntaxError"))
    functions = F.when(broken, by_pattern).otherwise(F.array(_defined()))
    return _entities(kept.select(*KEYS, F.inline(functions)))


def extract_entities(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Functions of every file by language; text of no known language has none.

    Pass a stored ``nodes`` table to avoid parsing again.
    """
    nodes = syntax_nodes(files, definitions_only=True) if nodes is None else nodes
    js = js_functions(files.filter(detect_language(F.col("content")) == "javascript"))
    return py_functions(nodes).unionByName(js).select(*ENTITY_COLUMNS)


def node_profile(nodes: DataFrame) -> DataFrame:
    """Node-type counts per definition, the definition itself included; its row has them."""
    counted = nodes.filter(F.col("node_type") == "FunctionDef").select(
        *KEYS, F.col("pre").alias("def_pre"), F.explode("profile").alias("node_type", "n")
    )
    return counted.groupBy(*KEYS, "def_pre", "node_type").agg(F.sum("n").cast("int").alias("n"))


#: What ``extract_imports`` reads.
IMPORTS = ("alias", "ImportFrom")


def extract_imports(nodes: DataFrame) -> DataFrame:
    plain = (F.col("node_type") == "alias") & (F.col("parent_type") == "Import")
    source = (F.col("node_type") == "ImportFrom") & F.col("name").isNotNull()
    return nodes.filter(plain | source).select(
        *KEYS,
        F.when(plain, F.col("parent_bfs")).otherwise(F.col("bfs")).alias("bfs"),
        F.when(plain, F.col("pos")).otherwise(0).alias("pos"),
        F.col("name").alias("imported"),
    )


def dotted_module(path: Column, roots=()) -> Column:
    """Dotted name of a Python file; a package's ``__init__.py`` has the package's name.

    ``roots`` are folders that imports leave out, such as ``src/``.
    """
    for root in roots:
        path = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    plain = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.replace(plain, F.lit("/"), F.lit("."))


def import_edges(files: DataFrame, imports: DataFrame, roots=()) -> DataFrame:
    """(project_id, snapshot_id, src, dst): files and the files of the same tree that they import.

    An import names a module, or something inside one: the longest prefix that is a module of the
    tree counts. Other imports (of libraries) and imports of oneself give no edge.
    """
    tree = ["project_id", "snapshot_id"]
    modules = (
        files.filter(F.endswith("path", F.lit(".py")))
        .select(*tree, dotted_module(F.col("path"), roots).alias("module"), "path")
        .filter("module <> ''").groupBy(*tree, "module").agg(F.min("path").alias("dst"))
    )
    parts = F.split("imported", r"\.")
    prefixes = (
        imports.select(*tree, F.col("path").alias("src"), "imported").distinct()
        .select("*", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
        .withColumn("module", F.array_join(F.slice(parts, 1, F.col("n")), "."))
    )
    # The engine takes modules for as small as the files that paths are read from, and would send
    # them all through the driver.
    found = prefixes.join(modules.hint("merge"), [*tree, "module"]).groupBy(*tree, "src", "imported").agg(
        F.max_by("dst", "n").alias("dst")
    )
    return found.filter("src <> dst").select(*tree, "src", "dst").distinct()


#: What ``extract_calls`` reads.
CALLS = ("Call",)


def extract_calls(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("node_type") == "Call") & F.col("name").isNotNull()).select(
        *KEYS, "bfs", F.col("name").alias("called")
    )


def extract_control_flow(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type").isin(*P.CONTROL_FLOW_NODES)).select(
        *KEYS, "bfs", F.col("node_type").alias("construct")
    )


def _inferred() -> Column:
    """Type of an assigned value, as far as its node tells it."""
    node_type = F.col("node_type")
    return (
        F.when(node_type == "Constant", F.col("const_type"))
        .when(node_type.isin("Dict", "List", "Tuple", "Set"), F.lower(node_type))
        .when(node_type == "Call", F.col("name"))
    )


def _is_value() -> Column:
    return (F.col("parent_type") == "Assign") & (F.col("field") == "value") & _inferred().isNotNull()


def _is_target() -> Column:
    return (
        (F.col("parent_type") == "Assign") & (F.col("field") == "targets")
        & (F.col("node_type") == "Name")
    )


def infer_variable_types(nodes: DataFrame) -> DataFrame:
    """Type of each simply assigned name; the last assignment in visiting order wins.

    Both sides of an assignment are read in one pass and meet in one grouping.
    """
    target = F.struct("parent_bfs", "pos", F.col("name").alias("variable"))
    assigned = (
        nodes.filter(_is_value() | _is_target())
        .groupBy(*KEYS, "parent_pre")
        .agg(
            F.max(F.when(_is_value(), _inferred())).alias("var_type"),
            F.collect_list(F.when(_is_target(), target)).alias("targets"),
        )
        .filter(F.col("var_type").isNotNull())
    )
    return (
        assigned.select(*KEYS, "var_type", F.inline("targets"))
        .groupBy(*KEYS, "variable")
        .agg(F.max_by("var_type", F.struct("parent_bfs", "pos")).alias("var_type"))
    )


#: What ``semantic_context`` reads; ``infer_variable_types`` reads the nodes below assignments only.
CONTEXT, ASSIGNED = ("Module", *CALLS, *IMPORTS, *P.CONTROL_FLOW_NODES), ("Assign",)


def semantic_context(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per parsed file with its variable types, calls, imports and constructs.

    The nodes are read once and grouped by file.
    """
    node_type, name = F.col("node_type"), F.col("name")

    def listed(hit: Column, value: Column, *order: Column) -> Column:
        places = [place.alias(f"place{k}") for k, place in enumerate(order)]
        found = F.array_sort(F.collect_list(F.when(hit, F.struct(*places, value.alias("value")))))
        return F.transform(found, lambda s: s["value"])

    plain = (node_type == "alias") & (F.col("parent_type") == "Import")
    source = (node_type == "ImportFrom") & name.isNotNull()
    per_file = nodes.groupBy(*KEYS).agg(
        F.max(node_type == "Module").alias("parsed"),
        listed((node_type == "Call") & name.isNotNull(), name, F.col("bfs")).alias("function_calls"),
        listed(
            plain | source, name, F.when(plain, F.col("parent_bfs")).otherwise(F.col("bfs")),
            F.when(plain, F.col("pos")).otherwise(0),
        ).alias("imports"),
        listed(node_type.isin(*P.CONTROL_FLOW_NODES), node_type, F.col("bfs")).alias("control_flow"),
        F.map_from_entries(F.collect_list(
            F.when(_is_value(), F.struct("parent_pre", _inferred().alias("var_type")))
        )).alias("types"),
        F.collect_list(F.when(_is_target(), F.struct("parent_bfs", "pos", "parent_pre", "name"))).alias("targets"),
    )
    typed = F.transform("targets", lambda t: F.struct(
        (-t["parent_bfs"]).alias("later"), (-t["pos"]).alias("place"), t["name"].alias("name"),
        F.col("types")[t["parent_pre"]].alias("var_type"),
    ))
    last = first_of_each_name(F.array_sort(F.filter(typed, lambda t: t["var_type"].isNotNull())))
    types = F.map_from_entries(F.array_sort(
        F.transform(last, lambda t: F.struct(t["name"].alias("key"), t["var_type"].alias("value")))
    ))
    return (
        files.select(*KEYS, "content").join(per_file.filter("parsed"), list(KEYS))
        .select(
            *KEYS, types.alias("variable_types"), "function_calls", "imports",
            F.regexp_replace("content", r"(?U)^\s+|\s+$", "").alias("surrounding_code"),
            "control_flow",
            F.create_map().cast("map<string,string>").alias("data_flow"),
        )
    )


#: ``call_arguments`` reads these and the nodes right below them.
KEYWORDS = ("keyword",)


def call_arguments(nodes: DataFrame) -> DataFrame:
    """Keyword arguments of calls with the kind of their value."""
    keywords = nodes.filter(
        (F.col("node_type") == "keyword") & (F.col("parent_type") == "Call")
    ).select(*KEYS, F.col("pre").alias("kw_pre"), F.col("parent_pre").alias("call_pre"),
             F.col("name").alias("kw"))
    values = nodes.filter(F.col("parent_type") == "keyword").select(
        *KEYS, F.col("parent_pre").alias("kw_pre"),
        F.when(F.col("node_type") == "Constant", "const").otherwise("expr").alias("value_kind"),
        F.coalesce("text", "name").alias("value"),
    )
    return keywords.join(values, [*KEYS, "kw_pre"]).drop("kw_pre")
