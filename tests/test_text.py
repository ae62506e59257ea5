"""Edge-case strings."""

import ast
import gc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmason.functions import text
from textmason.operators import evidence, extract, nodes, rules
from textmason.operators.rewrite import rewrite_chain
from textmason.plans.versions import extract_versions


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, content STRING")
    return [r.out for r in frame.select("i", expression(F.col("content")).alias("out")).orderBy("i").collect()]


REWRITES = {
    "timeout=30*1000": "timeout=30*1000",
    "timeout=30 * 1000": "timeout=30 * 1000",
    "timeout=30*10005": "timeout=30*10005",
    "timeout=120": "timeout=120",
    "timeout=100": "timeout=100",
    "timeout=99)": "timeout=99*1000)",
    "timeout=007": "timeout=7*1000",
    "timeout=00": "timeout=0*1000",
    "timeout=0100": "timeout=0100",
    "timeout=5.5": "timeout=5*1000.5",
    "self.timeout=timeout_s": "self.timeout=timeout * 1000_s",
    "self.timeout = timeout * 1000": "self.timeout = timeout * 1000",
    "requests.post(u, headers=h, data=p)": "requests.post(u, headers=h, data=p)",
    "requests.post(u, data=p)": "requests.post(u, json=p)",
    "requests.put(u,\n   data=p)": "requests.put(u, json=p)",
    "requests.get(u, data=p)": "requests.get(u, data=p)",
    "data=json.dumps(x)": "json=x",
    "data=json.dumps()": "data=json.dumps()",
    "requests.post(u, data=json.dumps(b), timeout=5)": "requests.post(u, json=b, timeout=5*1000)",
}


def test_rewrite_chain(spark):
    assert column(spark, REWRITES, rewrite_chain) == list(REWRITES.values())


def test_rewrite_chain_twice_changes_nothing_more(spark):
    once = column(spark, REWRITES, rewrite_chain)
    assert column(spark, once, rewrite_chain) == once


def found(spark, value, book=rules.RuleBook()):
    hits = column(spark, [value], lambda c: rules.matches_of(c, book))[0]
    return [(h.rule_name, h.matched, h.replacement) for h in hits]


@pytest.mark.parametrize("value", ["timeout=30*1000", "timeout=30 * 1000", "timeout=30*10005"])
def test_scaled_timeouts_do_not_match(spark, value):
    assert found(spark, value) == []


def test_matches_and_text_disagree_above_the_gate(spark):
    assert found(spark, "timeout=120") == [
        ("requests_timeout_scale", "timeout=120", "timeout=120*1000")
    ]
    assert column(spark, ["timeout=120"], rewrite_chain) == ["timeout=120"]


def test_matches_keep_rule_order_then_position(spark):
    value = "data=json.dumps(b), timeout=9, timeout=8"
    assert [m for _, m, _ in found(spark, value)] == [
        "timeout=9", "timeout=8", "data=json.dumps(b)"
    ]


def test_replacement_loses_its_surroundings(spark):
    rule = rules.Rule("behind", "method_replace", r"(?<=x)y", "z", 0.5)
    assert found(spark, "xy", rules.RuleBook((rule,))) == [("behind", "y", "y")]


def test_rules_of_one_name_replace_each_other_in_place():
    book = rules.RuleBook()
    changed = rules.Rule("requests_timeout_scale", "type_convert", "a", "b", 1.0)
    added = book.add_rule(rules.Rule("new", "method_replace", "c", "d", 0.0)).add_rule(changed)
    assert [r.name for r in added.rules] == ["requests_timeout_scale", "requests_data_to_json", "new"]
    assert added.rules[0] is changed
    assert book.rules == rules.DEFAULT_RULES


@pytest.mark.parametrize("confidence", [1.5, -0.1])
def test_confidence_outside_range_is_refused(confidence):
    with pytest.raises(ValueError):
        rules.Rule("r", "type_convert", "a", "b", confidence)


def test_rule_tables_are_checked(spark):
    good = rules.RuleBook().to_df(spark)
    assert rules.require_valid(good).count() == 2
    assert [r.name for r in rules.require_valid(good).orderBy("ord").collect()] == [
        "requests_timeout_scale", "requests_data_to_json"
    ]
    for broken in (good.withColumn("confidence", F.lit(1.5)), good.withColumn("type", F.lit("x"))):
        with pytest.raises(Exception, match="outside 0..1|unknown rule type"):
            rules.require_valid(broken).collect()
    usable, quarantined = rules.split_by_confidence(
        good.withColumn("confidence", F.when(F.col("ord") == 0, 2.0))
    )
    assert (usable.count(), quarantined.count()) == (0, 2)


def test_allowed_values(spark):
    status = lambda c: text.one_of(c, ("pending", "failed"), "status")
    assert column(spark, ["failed", "pending"], status) == ["failed", "pending"]
    with pytest.raises(Exception, match="unknown status: odd"):
        column(spark, ["odd"], status)


@pytest.mark.parametrize(
    "pattern, template, value, wanted",
    [
        (r"(a)(b)", r"\2\1", "ab", "ba"),
        (r"(a)", r"\g<1>0", "a", "a0"),
        (r"(?P<x>a)", r"<\g<x>>", "a", "<a>"),
        (r"a", r"$1 cost \\ 5", "a", "$1 cost \\ 5"),
        (r"a", r"x\ny", "a", "x\ny"),
        (r"(?P<q>['\"]).*?(?P=q)", "S", "'it\"' x", "S x"),
        (r"\w+", "w", "naïve", "w"),
        (r"(\d)7", r"\1 7 0", "17", "1 7 0"),
    ],
)
def test_rule_dialect(spark, pattern, template, value, wanted):
    rule = rules.Rule("r", "method_replace", pattern, template, 0.5)
    assert column(spark, [value], lambda c: rules.rewrite_from_rules(c, rules.RuleBook((rule,)))) == [wanted]


def test_apply_match_once_takes_the_first_occurrence(spark):
    once = lambda c: rules.apply_match_once(c, F.lit("a.b"), F.lit("X"))
    assert column(spark, ["1a.b a.b", "axb", "é a.b"], once) == ["1X a.b", "axb", "é X"]


def test_certificate_values(spark):
    import hashlib

    book = rules.RuleBook().add_rule(rules.Rule("plain", "method_replace", "zz", "z", 0.5))
    frame = spark.createDataFrame(
        [(1, "a.py", "timeout=5 data=json.dumps(b) zz"), (1, "b.py", "nothing")],
        "project_id BIGINT, path STRING, content STRING",
    )
    issued = F.lit("2024-05-01 00:00:00").cast("timestamp")
    rows = {r.path: r for r in evidence.plan_operations(frame, book, issued).collect()}
    certificate = rows["a.py"].certificate
    assert certificate.confidence == (0.9 + 0.85 + 0.5) / 3
    assert certificate.status == "verified"
    assert certificate.original_sha256 == hashlib.sha256(b"timeout=5 data=json.dumps(b) zz").hexdigest()
    assert certificate.rewritten_sha256 == hashlib.sha256(b"timeout=5*1000 json=b zz").hexdigest()
    assert [p.rule_name for p in certificate.proofs] == [
        "requests_timeout_scale", "requests_data_to_json", "plain"
    ]
    assert certificate.proofs[2].proof_obligation == (
        "Transformation 'plain' preserves behavioral semantics with confidence 0.50"
    )
    assert certificate.guarantee == (
        "All 3 transformation(s) preserve behavioral semantics with average confidence 0.75"
    )
    assert rows["a.py"].changes[2].description == "Apply plain"
    assert rows["b.py"].certificate is None
    assert [c.type for c in rows["b.py"].changes] == ["api_migration"]


def test_certificate_without_matches(spark):
    frame = spark.createDataFrame([("x",)], "content STRING")
    matches = F.filter(rules.matches_of(F.col("content"), rules.RuleBook()), lambda m: F.lit(True))
    certificate = evidence.certificate(
        [F.lit("p")], F.col("content"), F.col("content"), matches, F.current_timestamp()
    )
    row = frame.select(certificate.alias("c")).first().c
    assert (row.confidence, row.status, row.proofs) == (0.0, "unverified", [])


LANGUAGES = {
    "x = prefetch(1)": "javascript",
    "function f(a) {}": "javascript",
    "new XMLHttpRequest()": "javascript",
    "import React from 'r'": "python",
    "def f(a): pass": "python",
    "undef f(a)": "unknown",
    "define(1)": "unknown",
    "": "unknown",
}


def test_detect_language(spark):
    assert column(spark, LANGUAGES, text.detect_language) == list(LANGUAGES.values())


STEMS = {"a.b.py": "a.b", "x/y/.hidden": ".hidden", "x.d/README": "README", "a/..py": ".", "d/f.": "f."}


def test_module_name(spark):
    assert column(spark, STEMS, text.module_name) == list(STEMS.values())


def test_is_test_file(spark):
    names = {"test_a.py": True, "t/latest.py": True, "test/a.py": False, "test.txt": False, "a_test.JS": False}
    assert column(spark, names, text.is_test_file) == list(names.values())


def test_line_count(spark):
    assert column(spark, ["", "a", "a\n", "a\nb\n\n"], text.line_count) == [1, 1, 2, 4]


def test_two_decimals_rounds_ties_to_even(spark):
    frame = spark.createDataFrame([(0.125,), (0.375,), (0.9,), (0.8833333,)], "v DOUBLE")
    shown = [r.s for r in frame.select(text.two_decimals(F.col("v")).alias("s")).collect()]
    assert shown == ["0.12", "0.38", "0.90", "0.88"]


def usages(files, code, api):
    rows = extract.extract_api_usage(files({"a": code}), api).orderBy("ord").collect()
    return [(r.api_name, r.url, r.method, r.kwargs) for r in rows]


def test_python_usages(files):
    code = (
        'requests.get("https://a/1", timeout=30)\n'
        "requests.get(u, headers=h(1), timeout=4)\n"
        "requests.post(f'{base}/x', timeout = 7)\n"
        "s = myrequests.Session()\n"
    )
    assert usages(files, code, "requests") == [
        ("requests.get", "https://a/1", None, {"timeout": "30"}),
        ("requests.get", "", None, {}),
        ("requests.post", "{base}/x", None, {"timeout": "7"}),
        ("requests.Session", "", None, {}),
    ]
    assert usages(files, code, "fetch") == []
    assert usages(files, code, "other") == []


def test_javascript_usages(files):
    code = (
        "fetch('/a', { method: 'PUT', timeout: 5 }); fetch(`/b`, {x: 1});\n"
        "fetch('/c'); fetch(url, {a: 1}); fetch('/d', {h: {n: 1}, method: 'POST'})"
    )
    assert usages(files, code, "fetch") == [
        ("fetch", "/a", "PUT", {"timeout": "5"}),
        ("fetch", "/b", "GET", {}),
        ("fetch", "/d", "GET", {}),
    ]
    assert usages(files, "fetch(1); requests.get('https://a')", "requests") == []


def entities(files, code, path="m.py"):
    rows = nodes.extract_entities(files({path: code})).orderBy("ord").collect()
    return [(r.name, [(a.name, a.type) for a in r.args]) for r in rows]


def test_javascript_functions(files):
    code = (
        "const late = (p, q = 2) => p\nfunction f(a,, b ) {}\nasync function g(x) {}\n"
        "function g(y, z) {}\nlet h = async x => x\nvar i = async (u) => u\nfetch(1)"
    )
    named = lambda *names: [(n, "unknown") for n in names]
    assert entities(files, code, "m.js") == [
        ("g", named("x")), ("f", named("a", "b")), ("late", named("p", "q = 2")), ("h", []),
        ("i", named("u")),
    ]


def test_python_functions_by_tree(files):
    code = '''
async def q(): pass
class A:
    """doc"""
    async def skipped(self): pass
    def m(self, a: "int", /, b: list[int] = None, *c, d=1, **e):
        """
        First.

            Indented.
        """
        def inner(z): pass
    class B:
        def n(self): pass
if True:
    def cond(x, y=lambda w: 1): pass
def last(): pass
'''
    assert entities(files, code) == [
        ("A.m", [("b", "list[int]")]),
        ("last", []),
        ("B.n", [("self", "unknown")]),
        ("cond", [("x", "unknown"), ("y", "unknown")]),
        ("inner", [("z", "unknown")]),
    ]
    rows = nodes.extract_entities(files({"m.py": code})).collect()
    assert {r.docstring for r in rows if r.name == "A.m"} == {"First.\n\n    Indented."}


def test_python_functions_by_pattern(files):
    code = "def a(self, x: int, y=1, *z):\n  pass\ndef c(x) -> int: pass\ndef a(): pass\nprint 'old'"
    named = lambda *names: [(n, "unknown") for n in names]
    assert entities(files, code) == [("a", named("x: int", "y", "*z")), ("a", [])]
    assert entities(files, "import x\n\0") == entities(files, "plain text") == []


def test_profile_and_tree_agree_with_a_walk(files):
    import ast
    from collections import Counter

    code = open(nodes.__file__).read()
    rows = nodes.extract_entities(files({"n.py": code})).collect()
    tree = ast.parse(code)
    wanted = Counter()
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            kinds = Counter(
                type(n).__name__ for n in ast.walk(node)
                if not isinstance(n, (ast.Load, ast.Store, ast.alias, ast.Name))
            )
            wanted[(node.name, tuple(sorted(kinds.items())))] += 1
    found = Counter((r.name.split(".")[-1], tuple(sorted(r.profile.items()))) for r in rows)
    assert found == wanted
    listed = nodes.syntax_nodes(files({"n.py": code})).orderBy("bfs").collect()
    walked = [n for n in ast.walk(tree) if not isinstance(n, (ast.Load, ast.Store))]
    assert [r.node_type for r in listed] == [type(n).__name__ for n in walked]
    assert [r.bfs for r in listed] == list(range(len(walked)))
    by_pre = {r.pre: r for r in listed}
    for r in listed:
        inside = sum(1 for o in listed if r.pre <= o.pre <= r.post)
        assert inside == 1 + sum(
            by_pre[c.pre].post - c.pre + 1 for c in listed if c.parent_pre == r.pre
        )
        if r.pre > 50:
            break


def test_context(files):
    code = '''
import os, sys.path
from a.b import c
from . import d
url = "x"
data = {"k": 1}
n = m = 5
pair, other = 1, 2
response = client.api.get(url)
odd = f().g()
def fn():
    url = [1]
    for i in (1,):
        while i: pass
if n:
    try: h()
    finally: pass
'''
    table = files({"m.py": code, "w.js": "function f() { fetch(1) }", "bad.py": "import x\n(("})
    rows = nodes.semantic_context(table, nodes.syntax_nodes(table)).collect()
    assert [r.path for r in rows] == ["m.py"]
    row = rows[0]
    assert row.imports == ["os", "sys.path", "a.b"]
    assert row.variable_types == {
        "url": "list", "data": "dict", "n": "int", "m": "int", "response": "client.api.get",
        "odd": "g",
    }
    assert row.function_calls == ["client.api.get", "g", "f", "h"]
    assert row.control_flow == ["If", "For", "Try", "While"]
    assert row.surrounding_code == code.strip()
    assert row.data_flow == {}


def test_call_arguments(files):
    table = files({"m.py": "import r\nr.get(u, timeout=30, data='payload', n=None, other=x.y)\n"})
    args = nodes.call_arguments(nodes.syntax_nodes(table))
    changed = rules.apply_patterns(
        args, [rules.scale_keyword("timeout", 1000), rules.scale_keyword("n", 2),
               rules.rename_keyword("data", "json")]
    )
    assert {(r.kw, r.value_kind, r.value) for r in changed.collect()} == {
        ("timeout", "expr", "30 * 1000"), ("json", "const", "'payload'"),
        ("n", "expr", "None * 2"), ("other", "expr", "x.y"),
    }


def test_an_empty_catalogue_plans_one_generic_change(files):
    from textmason.operators.evidence import plan_operations
    from textmason.operators.rules import RuleBook, match_rules

    rows = files({"a.py": "import requests\nrequests.get(u, timeout=5)\n"})
    assert match_rules(rows, RuleBook(())).count() == 0
    plan = plan_operations(rows, RuleBook(()), F.lit("2024-01-01").cast("timestamp")).first()
    assert [c.type for c in plan.changes] == ["api_migration"] and plan.certificate is None


def test_dotted_names_leave_out_what_is_no_name(files):
    from textmason.operators.nodes import extract_calls, syntax_nodes

    code = "a.b.c(1)\nf().x.y(2)\n(p or q).z()\n[1][0]()\nlambda: g()\nh(k.m(), n=o.r())\n"
    found = extract_calls(syntax_nodes(files({"a.py": code + "def f(): pass\n"}))).collect()
    assert sorted(r.called for r in found) == ["a.b.c", "f", "g", "h", "k.m", "o.r", "x.y", "z"]


def test_queries_over_nodes_parse_once(files):
    rows = files({"a.py": "x = y = 1\nz = [f()]\nx = 'a'\nimport os\n"})
    for found in (
        nodes.infer_variable_types(nodes.syntax_nodes(rows)),
        nodes.semantic_context(rows, nodes.syntax_nodes(rows)),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
    assert found.first().variable_types == {"x": "str", "y": "int", "z": "list"}


def test_equal_texts_are_parsed_once(spark, files):
    old = {f"d{k}/m{k}.py": f"import a{k % 10}\ndef f{k % 10}(a, b=1):\n    return a\n" for k in range(40)}
    old |= {"broken.py": "def f(:\n", "w.js": "function q(a) {}\nfetch(1)", "e.py": ""}
    new = old | {f"d{k}/m{k}.py": f"import z\ndef g{k}(): pass\n" for k in range(4)}
    versions = files(old), files(new, snapshot_id=2)
    parsed = nodes.parse_once(*versions)
    python = {t for version in (old, new) for path, t in version.items() if path != "w.js" and t}
    assert nodes.distinct_texts(*versions).count() <= len(python) + 1
    assert parsed.select("text_hash").distinct().count() <= len(python) + 1 < len(old)
    for version in versions:
        same = [sorted(map(str, rows.collect())) for rows in (nodes.syntax_nodes(version), nodes.nodes_of(version, parsed))]
        assert same[0] == same[1] and same[0]
    apart = [sorted(map(str, nodes.extract_entities(version).collect())) for version in versions]
    together = [sorted(map(str, rows.collect())) for rows in extract_versions(*versions)]
    assert apart == together


def test_readers_of_few_nodes_are_sent_few(spark, files):
    code = """import a.b, c
from d import e
class K:
    def m(self, x: int, y: 'z' = 1) -> int:
        \'\'\' Two.
            lines\'\'\'
        self.t = f.g(x).h(k=x, n=-1, s="q", u=u"r")
        v = f.g(x)
        while x:
            del y
"""
    table = files({"a.py": code, "broken.py": "def f(a):\n  (", "e.py": "import os"})
    whole = nodes.syntax_nodes(table)
    rows = lambda df: sorted(map(str, df.collect()))
    broken = F.col("node_type").isin("SyntaxError", "Unparsable")
    for kinds, under in (
        (nodes.DEFINITIONS, ()), (nodes.CALLS, ()), (nodes.IMPORTS, ()), ((), nodes.ASSIGNED),
        (nodes.KEYWORDS, nodes.KEYWORDS), (nodes.CONTEXT, nodes.ASSIGNED),
    ):
        kept = F.col("node_type").isin(*kinds) | F.col("parent_type").isin(*under) | broken
        assert rows(nodes.syntax_nodes(table, kinds=kinds, under=under)) == rows(whole.filter(kept)) != []
    few = lambda *wanted: nodes.syntax_nodes(table, kinds=wanted[0], under=wanted[1])
    for read, wanted in (
        (nodes.node_profile, (nodes.DEFINITIONS, ())), (nodes.infer_variable_types, ((), nodes.ASSIGNED)),
        (nodes.call_arguments, (nodes.KEYWORDS, nodes.KEYWORDS)), (nodes.py_functions, (nodes.DEFINITIONS, ())),
        (lambda some: nodes.semantic_context(table, some), (nodes.CONTEXT, nodes.ASSIGNED)),
    ):
        assert rows(read(few(*wanted))) == rows(read(whole)) != []


def test_modules_are_not_sent_through_the_driver(spark, files):
    tree = files({"a.py": "import b.c", "b.py": ""})
    edges = nodes.import_edges(tree, nodes.extract_imports(nodes.syntax_nodes(tree)))
    assert [(r.src, r.dst) for r in edges.collect()] == [("a.py", "b.py")]
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_imports_resolve_to_the_longest_module(spark, files):
    tree = files({
        "src/a/__init__.py": "import b", "src/a/b.py": "import a.c.d.E, os.path\nfrom a import x",
        "src/a/c/d.py": "from . import y\nimport a.c.d\n", "src/b.py": "", "src/a/c.py": "import a.b.c",
        "src/__init__.py": "import src", "n.js": "",
    })
    imports = nodes.extract_imports(nodes.syntax_nodes(tree))
    found = {(r.src, r.dst) for r in nodes.import_edges(tree, imports, roots=("src/",)).collect()}
    assert found == {
        ("src/a/__init__.py", "src/b.py"), ("src/a/b.py", "src/a/c/d.py"), ("src/a/b.py", "src/a/__init__.py"),
        ("src/a/c.py", "src/a/b.py"),
    }
    whole = {(r.src, r.dst) for r in nodes.import_edges(tree, imports).collect()}
    assert whole == {("src/__init__.py", "src/__init__.py")} - {("src/__init__.py", "src/__init__.py")}


@pytest.mark.parametrize("pattern, literal", [
    (r"timeout=(\d+)", "timeout="), (r"a|b", ""), (r"(?i)get", ""), (r"(ab)+cde?", "ab"), (r"x*yz", "yz"),
    (r"foo(?:bar)baz", "foobarbaz"), (r"\bword\b", "word"), (r"[ab]cd", "cd"), (r"(?P<n>get)_\w+(?P=n)", "get_"),
    (r"(?:ab|cd)efg", "efg"), (r"a{2}bcd", "bcd"), (r"", ""), (r"(?i:GET)xy", "xy"), (r"ab(?=cd)ef", "ab"),
])
def test_literals_that_a_pattern_requires(pattern, literal):
    assert rules.required_literal(pattern) == literal


def test_a_thousand_rules_match_as_rule_by_rule(spark, files):
    import random
    import re

    rng = random.Random(3)
    book = rules.RuleBook()
    for k in range(1000):
        pattern, replacement = rng.choice([
            (rf"call_{k}\((\w*)\)", r"new_%d(\1)" % k), (rf"k{k}=(\d+)", rf"q{k}=\g<1>0"), (rf"\bw{k}\b", "v"),
            (rf"(?i)Name{k}\b", "n"), (r"z" * (k % 5 + 1) + str(k), "y"),
        ])
        book = book.add_rule(rules.Rule(f"r{k}", rules.P.RULE_TYPES[0], pattern, replacement, 0.5))
    words = ["call_{0}(x)", "k{0}=12", "w{0}", "naME{0}", "zz{0}", "timeout=5"]
    texts = {f"t{k}.py": " ".join(rng.choice(words).format(rng.randrange(1000)) for _ in range(30)) for k in range(30)}
    texts |= {"empty.py": "", "none.py": "nothing"}
    frame = files(texts).unionByName(files({"null.py": "x"}).withColumn("content", F.lit(None).cast("string")))
    found = rules.match_rules(frame, book)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    few = rules._match_by_index(frame, rules.RuleBook(), ("project_id", "path"))
    assert len(plan) < len(few._jdf.queryExecution().optimizedPlan().toString()) + 200
    rows = sorted((r.path, r.rule_ord, r.match_ord, r.matched, r.replacement) for r in found.collect())
    wanted = sorted(
        (path, order, place, m.group(), re.sub(rule.pattern, rule.replacement, m.group()))
        for path, text in texts.items() for order, rule in enumerate(book.rules)
        for place, m in enumerate(re.finditer(rule.pattern, text))
    )
    assert rows == wanted and len(rows) > 200
    unrolled = files(texts).select("project_id", "path", F.inline(rules.matches_of(F.col("content"), rules.RuleBook())))
    indexed = rules._match_by_index(files(texts), rules.RuleBook(), ("project_id", "path"))
    assert indexed.columns == unrolled.columns
    assert sorted(map(str, indexed.collect())) == sorted(map(str, unrolled.collect()))


def test_rows_of_definitions_are_those_of_the_whole_table():
    texts = [
        "", "x = 1", "def f(:", "def f(): del a.b[0], (c, d)\ndef g(): return c",
        "class A:\n  def f(self, a: int, b: 'x'=1):\n    '''Doc'''\n    def g():\n      del a\n"
        "      return [lambda q: q for q in a]\n    async def h():\n      def k(z: list[int]): pass\n  def m(self): ...",
        "if 1:\n  @d(1)\n  def y(*, a, **k) -> int:\n    x: int = 1\n    return x.y.z\nimport os\nfrom . import x",
    ]
    for text in texts:
        whole = [row for row in nodes.tree_rows(text) if row[9] in ("FunctionDef", "SyntaxError")]
        assert nodes.tree_rows(text, nodes.DEFINITIONS) == whole


def test_parsing_leaves_no_collector_running(monkeypatch):
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1], pa.int64()), pa.array([1], pa.int32()), pa.array(["a.py"]), pa.array(["def f(): pass"])],
        names=["project_id", "snapshot_id", "path", "content"],
    )
    during, parse = [], ast.parse
    monkeypatch.setattr(nodes.ast, "parse", lambda text: during.append(gc.isenabled()) or parse(text))
    assert gc.isenabled()
    assert [b.num_rows for b in nodes._parser(nodes.DEFINITIONS)([batch])] == [1]
    assert during == [False] and gc.isenabled()
