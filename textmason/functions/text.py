"""Column expressions over paths and file text. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmason.functions import patterns as P


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_name(path: Column) -> Column:
    """Last path segment without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def relative_path(path: Column, root: str, file_mode: bool = False) -> Column:
    if file_mode:
        return base_name(path)
    return F.substr(path, F.lit(len(root.rstrip("/")) + 2))


def is_code_file(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(path, F.lit(s)) for s in P.CODE_SUFFIXES])


def is_test_file(path: Column) -> Column:
    return is_code_file(path) & base_name(path).contains("test")


def detect_language(content: Column) -> Column:
    """First hit wins. The substring tests are cheap and run before the searches."""
    js = reduce(lambda a, b: a | b, [content.contains(s) for s in P.LANGUAGE_JS_LITERALS])
    js = js | (content.contains("function") & content.rlike(P.LANGUAGE_JS_FUNCTION))
    py = content.contains(P.LANGUAGE_PY_LITERAL) | (
        content.contains("def") & content.rlike(P.LANGUAGE_PY_FUNCTION)
    )
    return F.when(js, "javascript").when(py, "python").otherwise("unknown")


def has_opportunity(content: Column, include_payload: bool = True) -> Column:
    """True where a file is worth migrating; single-file mode skips the payload test."""
    hit = content.rlike(P.OPPORTUNITY_TIMEOUT) | content.rlike(P.OPPORTUNITY_CALL)
    return (hit | content.rlike(P.OPPORTUNITY_PAYLOAD)) if include_payload else hit


def normalise_newlines(content: Column) -> Column:
    return F.regexp_replace(content, r"\r\n?", "\n")


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def two_decimals(value: Column) -> Column:
    """Two decimals with ties to even."""
    return F.format_string("%.2f", F.bround(value, 2))


def fill(sentence: str, *values: Column) -> Column:
    """A sentence with its braces filled by columns."""
    pieces = [F.lit(piece) for piece in sentence.split("{}")]
    filled = [c for pair in zip(pieces, values) for c in pair]
    return F.concat(*filled, *pieces[len(values):])


def one_of(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value itself; a row with any other value fails the job."""
    message = F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(message))


def split_params(params: Column, keep_self: bool = True, cut_default: bool = False) -> Column:
    """Comma-separated parameter text as ``ARRAY<STRUCT<name, type>>``."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(params, ","), strip), lambda p: p != "")
    if not keep_self:
        parts = F.filter(parts, lambda p: p != "self")
    if cut_default:
        parts = F.transform(parts, lambda p: strip(F.substring_index(p, "=", 1)))
    return F.transform(
        parts, lambda p: F.struct(p.alias("name"), F.lit("unknown").alias("type"))
    )
