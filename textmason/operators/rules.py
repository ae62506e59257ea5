"""Rule catalogue and rule matching.

A catalogue is rows of configuration. A handful is unrolled into column expressions, so
matching needs no join with the files, every pattern is a constant the JVM compiles once,
and a file's matches never leave its row. More are asked through an index of literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmason.functions import patterns as P
from textmason.functions.text import one_of

RULE_SCHEMA = (
    "ord INT, name STRING, type STRING, pattern STRING, replacement STRING, "
    "confidence DOUBLE, description STRING, proof_obligation STRING, "
    "conditions ARRAY<STRING>, context_requirements MAP<STRING,STRING>"
)


@dataclass(frozen=True)
class Rule:
    """One rewrite rule; ``pattern`` and ``replacement`` use Python's regex syntax."""

    name: str
    type: str
    pattern: str
    replacement: str
    confidence: float
    description: str = ""
    proof_obligation: str = ""
    conditions: tuple[str, ...] = ()
    context_requirements: dict[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not 0.0 <= self.confidence <= 1.0:
            raise ValueError(f"confidence {self.confidence} lies outside 0..1")
        if self.type not in P.RULE_TYPES:
            raise ValueError(f"unknown rule type {self.type!r}")


# The two default rules ---------------------------------------------
DEFAULT_RULES = (
    Rule(
        name="requests_timeout_scale",
        type="parameter_scale",
        pattern=r"timeout=(\d+)(?!\s*\*\s*1000)(?=\D|$)",
        replacement=r"timeout=\1*1000",
        confidence=0.9,
        description="Scale timeout from seconds to milliseconds",
        proof_obligation=(
            "Preserves timeout behavior: timeout_seconds * 1000 = timeout_milliseconds"
        ),
    ),
    Rule(
        name="requests_data_to_json",
        type="parameter_rename",
        pattern=r"data=json\.dumps\(([^)]+)\)",
        replacement=r"json=\1",
        confidence=0.85,
        description="Rename data parameter to json for requests",
        proof_obligation="Parameter rename preserves payload semantics: json=x ≡ json=x",
    ),
)
# ---------------------------------------------------------------------------------


def java_pattern(pattern: str) -> str:
    """Python search pattern in Java syntax."""
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return "(?U)" + pattern


def java_replacement(template: str) -> str:
    """Python replacement template in Java syntax: groups become ``$n``."""
    piece = re.compile(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)|([$\\])|(\d)", re.S)
    escapes = {"n": "\n", "t": "\t", "r": "\r"}
    after_group = False

    def swap(m: re.Match) -> str:
        nonlocal after_group
        adjacent = after_group and m.start() == swap.end
        named, number, escaped, special, digit = m.groups()
        swap.end = m.end()
        after_group = bool(named or number)
        if named or number:
            group = named or number
            return f"${group}" if group.isdigit() else f"${{{group}}}"
        if escaped:
            return escapes.get(escaped, "\\" + escaped)
        if special:
            return "\\" + special
        return "\\" + digit if adjacent else digit

    swap.end = -1
    return piece.sub(swap, template)


@dataclass(frozen=True)
class RuleBook:
    """Ordered rules; a rule of a known name replaces it in place."""

    rules: tuple[Rule, ...] = DEFAULT_RULES

    def add_rule(self, rule: Rule) -> RuleBook:
        known = {r.name: r for r in self.rules}
        known[rule.name] = rule
        return RuleBook(tuple(known.values()))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, r.name, r.type, r.pattern, r.replacement, r.confidence, r.description,
             r.proof_obligation, list(r.conditions), dict(r.context_requirements))
            for i, r in enumerate(self.rules)
        ]
        return spark.createDataFrame(rows, RULE_SCHEMA)


def upsert_rules(rules: DataFrame, version: str = "seq") -> DataFrame:
    """One row per name: the latest definition at the earliest position."""
    body = [c for c in rules.columns if c not in ("name", "ord", version)]
    latest = F.max_by(F.struct(*body), F.col(version))
    return (
        rules.groupBy("name")
        .agg(F.min("ord").alias("ord"), latest.alias("latest"))
        .select("name", "ord", "latest.*")
    )


def split_by_confidence(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) rules; a missing confidence is quarantined."""
    usable = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    return rules.filter(usable), rules.filter(~usable)


def require_valid(rules: DataFrame) -> DataFrame:
    """The same rules; an unknown type or a confidence outside 0..1 fails the job."""
    confidence = F.col("confidence")
    return rules.withColumns({
        "type": one_of(F.col("type"), P.RULE_TYPES, "rule type"),
        "confidence": F.when(confidence.between(0.0, 1.0), confidence).otherwise(
            F.raise_error(F.concat(F.lit("confidence outside 0..1 in rule "), F.col("name")))
        ),
    })


def replacement_text(matched: Column, rule: Rule) -> Column:
    """Replacement worked out on the matched fragment alone, without its surroundings."""
    return F.regexp_replace(matched, java_pattern(rule.pattern), java_replacement(rule.replacement))


MATCHES = (
    "ARRAY<STRUCT<rule_ord: INT, match_ord: INT, rule_name: STRING, rule_type: STRING, "
    "description: STRING, proof_obligation: STRING, matched: STRING, replacement: STRING, "
    "confidence: DOUBLE>>"
)


def sentences(rule: Rule) -> tuple[str, str]:
    """(proof obligation, description) of a rule, its own or made of its name."""
    obligation = rule.proof_obligation or P.PROOF_SENTENCE.format(
        name=rule.name, confidence=rule.confidence
    )
    return obligation, rule.description or P.CHANGE_SENTENCE.format(name=rule.name)


def matches_of(content: Column, book: RuleBook) -> Column:
    """All hits of all rules in rule order, then position, as one array."""

    def hits(order: int, rule: Rule) -> Column:
        found = F.regexp_extract_all(content, F.lit(java_pattern(rule.pattern)), F.lit(0))
        obligation, description = sentences(rule)
        return F.transform(
            found,
            lambda text, position: F.struct(
                F.lit(order).alias("rule_ord"),
                position.alias("match_ord"),
                F.lit(rule.name).alias("rule_name"),
                F.lit(rule.type).alias("rule_type"),
                F.lit(description).alias("description"),
                F.lit(obligation).alias("proof_obligation"),
                text.alias("matched"),
                replacement_text(text, rule).alias("replacement"),
                F.lit(rule.confidence).alias("confidence"),
            ),
        )

    none = F.array().cast(MATCHES)
    return F.concat(none, *[hits(i, rule) for i, rule in enumerate(book.rules)])


#: A catalogue of more rules is asked through an index of literals instead of rule by rule.
MOST_UNROLLED = 16
_REPEATS = (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT, re._constants.POSSESSIVE_REPEAT)


def required_literal(pattern: str) -> str:
    """The longest text that every match of a pattern holds, as far as its parts show; '' if none.

    Branches, optional parts and parts that ignore case require nothing here.
    """
    found, run = [""], []

    def end():
        found.append("".join(run))
        run.clear()

    def walk(parts):
        for kind, value in parts:
            if kind is re._constants.LITERAL:
                run.append(chr(value))
            elif kind is re._constants.SUBPATTERN and not (value[1] or value[2]) & re.IGNORECASE:
                walk(value[3])
            elif kind in _REPEATS and value[0] > 0:
                end()  # what is repeated occurs, but not next to what surrounds it
                walk(value[2])
                end()
            elif kind is not re._constants.AT:  # a place takes no characters
                end()

    parsed = re._parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    walk(parsed)
    end()
    return max(found, key=len)


class RuleIndex:
    """Rules by the literals they require; a text is asked once for all of them."""

    def __init__(self, book: RuleBook):
        self.rules = book.rules
        self.compiled = [re.compile(rule.pattern) for rule in self.rules]
        self.by_literal: dict[str, list[int]] = {}
        for order, rule in enumerate(self.rules):
            self.by_literal.setdefault(required_literal(rule.pattern), []).append(order)
        self.always = self.by_literal.pop("", [])
        # literals by a short start: one search over the text finds all places where some begins
        self.starts: dict[str, list[str]] = {}
        for literal in self.by_literal:
            self.starts.setdefault(literal[:LITERAL_START], []).append(literal)
        sizes = sorted({len(start) for start in self.starts})
        self.sizes = sizes

    def candidates(self, text: str) -> list[int]:
        """Rules that may match, in order."""
        found = set(self.always)
        for size in self.sizes:
            held = {text[k : k + size] for k in range(len(text) - size + 1)}
            for start in held & self.starts.keys():
                for literal in self.starts[start]:
                    if literal in text:
                        found.update(self.by_literal[literal])
        return sorted(found)

    def hits(self, text: str):
        """(rule, place among its matches, matched, replacement) in rule order, then position."""
        for order in self.candidates(text):
            pattern, rule = self.compiled[order], self.rules[order]
            for place, match in enumerate(pattern.finditer(text)):
                matched = match.group()
                yield order, place, matched, pattern.sub(rule.replacement, matched)


#: Characters of a literal by which texts are searched for it.
LITERAL_START = 4


def _match_by_index(files: DataFrame, book: RuleBook, keys) -> DataFrame:
    """As ``match_rules``; the plan is the same for any number of rules."""
    keyed = files.select(*keys, "content")
    width = len(keys)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:width]]
    schema = ", ".join([*fields, MATCHES.removeprefix("ARRAY<STRUCT<").removesuffix(">>")])
    names = [*keyed.columns[:width], "rule_ord", "match_ord", "rule_name", "rule_type", "description",
             "proof_obligation", "matched", "replacement", "confidence"]
    kinds = [pa.int32(), pa.int32(), *[pa.string()] * 6, pa.float64()]

    def run(batches):
        index = RuleIndex(book)
        for batch in batches:
            rows, places = [], []
            for k, text in enumerate(batch.column(width).to_pylist()):
                for order, place, matched, replaced in index.hits(text) if text is not None else ():
                    rule = book.rules[order]
                    obligation, description = sentences(rule)
                    places.append(k)
                    rows.append((order, place, rule.name, rule.type, description, obligation, matched, replaced,
                                 rule.confidence))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            kept = [column.take(pa.array(places, pa.int64())) for column in batch.columns[:width]]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names=names
            )

    return keyed.mapInArrow(run, schema)


def match_rules(files: DataFrame, book: RuleBook, keys=("project_id", "path")) -> DataFrame:
    """One row per hit."""
    if len(book.rules) > MOST_UNROLLED:
        return _match_by_index(files, book, keys)
    return files.select(*keys, F.inline(matches_of(F.col("content"), book)))


def apply_match_once(content: Column, matched: Column, replacement: Column) -> Column:
    """Replace the first literal occurrence of ``matched``."""
    at = F.instr(content, matched)
    return F.when(
        at > 0, F.overlay(content, replacement, at, F.length(matched))
    ).otherwise(content)


def rewrite_from_rules(content: Column, book: RuleBook) -> Column:
    """Opt-in: rewrite text by the catalogue instead of the fixed chain."""
    for rule in book.rules:
        content = replacement_text(content, rule)
    return content


@dataclass(frozen=True)
class KeywordPattern:
    """User extension: a predicate and a rewrite over a call-argument row."""

    name: str
    matches: Callable[[], Column]
    transform: Callable[[], dict[str, Column]]


def scale_keyword(parameter: str, factor: int) -> KeywordPattern:
    """A constant bound to ``parameter`` is multiplied, whatever its type."""
    return KeywordPattern(
        f"scale_{parameter}",
        lambda: (F.col("kw") == parameter) & (F.col("value_kind") == "const"),
        lambda: {
            "value": F.concat(F.col("value"), F.lit(f" * {factor}")),
            "value_kind": F.lit("expr"),
        },
    )


def rename_keyword(old: str, new: str) -> KeywordPattern:
    return KeywordPattern(
        f"rename_{old}", lambda: F.col("kw") == old, lambda: {"kw": F.lit(new)}
    )


def apply_patterns(call_args: DataFrame, patterns: list[KeywordPattern]) -> DataFrame:
    """Apply patterns in order to a call-argument table."""
    for pattern in patterns:
        hit = F.coalesce(pattern.matches(), F.lit(False))
        call_args = call_args.withColumns(
            {c: F.when(hit, v).otherwise(F.col(c)) for c, v in pattern.transform().items()}
        )
    return call_args
