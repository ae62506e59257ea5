"""Pattern-based extraction of functions and API calls: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.functions import patterns as P
from textmason.functions.text import detect_language, module_name, split_params

KEYS = ("project_id", "snapshot_id", "path")
ENTITY_COLUMNS = (
    *KEYS, "ord", "module", "name", "language", "args", "docstring", "profile",
)


def _groups(content: Column, pattern: str, *names: str) -> Column:
    """Every hit of ``pattern`` as a struct of its first groups."""
    found = [
        F.regexp_extract_all(content, F.lit(pattern), F.lit(i + 1)).alias(n)
        for i, n in enumerate(names)
    ]
    return F.arrays_zip(*found)


def _as_entities(hits: DataFrame, order: Column, language: str, args: Column) -> DataFrame:
    return hits.select(
        *KEYS,
        order.alias("ord"),
        module_name(F.col("path")).alias("module"),
        "name",
        F.lit(language).alias("language"),
        args.alias("args"),
        F.lit(None).cast("string").alias("docstring"),
        F.lit(None).cast("map<string,int>").alias("profile"),
    )


def dedup_first_wins(hits: DataFrame, keys: tuple[str, ...], order: Column) -> DataFrame:
    """Earliest row per key; map-side combining leaves little to shuffle."""
    rest = [c for c in hits.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order).alias("first")
    return hits.groupBy(*keys).agg(first).select(*keys, "first.*")


def js_function_hits(content: Column) -> Column:
    """Hits of the three passes, numbered (pass, position), before deduplication.

    A text that lacks what a pattern always matches is not searched for it.
    """
    def hits(number: int, pattern: str) -> Column:
        return F.transform(
            _groups(content, pattern, "name", "params"),
            lambda group, position: F.struct(
                F.lit(number).alias("pass"),
                position.alias("position"),
                group["name"].alias("name"),
                group["params"].alias("params"),
            ),
        )

    passes = ((P.JS_ASYNC_FUNCTION, "async"), (P.JS_PLAIN_FUNCTION, "function"), (P.JS_ARROW_FUNCTION, "=>"))
    none = F.array().cast("array<struct<pass:int,position:int,name:string,params:string>>")
    return F.concat(*[
        F.when(F.contains(content, F.lit(needed)) | content.isNull(), hits(number, pattern)).otherwise(none)
        for number, (pattern, needed) in enumerate(passes)
    ])


def first_of_each_name(hits: Column) -> Column:
    """The first element of every name in an array; a file's hits never leave its row."""
    def among(found: Column) -> Column:
        names = F.array(F.transform(found, lambda hit: hit["name"]))
        return F.flatten(F.transform(names, lambda known: F.filter(
            found, lambda hit, at: F.array_position(known, hit["name"]) == at + 1
        )))

    return F.flatten(F.transform(F.array(hits), among))


def _js_order(step: Column, position: Column) -> Column:
    return step.cast("long") * (1 << 32) + position


def js_functions(files: DataFrame) -> DataFrame:
    found = first_of_each_name(js_function_hits(F.col("content")))
    hits = files.select(*KEYS, F.inline_outer(found)).filter(F.col("name").isNotNull())
    order = _js_order(F.col("pass"), F.col("position"))
    return _as_entities(hits, order, "javascript", split_params(F.col("params")))


def pattern_functions(content: Column) -> Column:
    """Python functions found by pattern, as an array of (name, params)."""
    return _groups(content, P.PY_FUNCTION, "name", "params")


def pattern_params(params: Column) -> Column:
    return split_params(params, keep_self=False, cut_default=True)


def py_functions_regex(files: DataFrame) -> DataFrame:
    """Fallback for Python text that does not parse."""
    hits = files.select(
        *KEYS, F.posexplode(pattern_functions(F.col("content"))).alias("position", "hit")
    ).select(*KEYS, "position", "hit.*")
    return _as_entities(
        hits, F.col("position").cast("long"), "python", pattern_params(F.col("params"))
    )


def functions_by_pattern(files: DataFrame) -> DataFrame:
    """``js_functions`` of files named ``.js`` and ``py_functions_regex`` of the others, in one pass."""
    content = F.col("content")
    language = F.when(F.endswith("path", F.lit(".js")), "javascript").otherwise("python")
    js = F.transform(first_of_each_name(js_function_hits(content)), lambda hit: F.struct(
        _js_order(hit["pass"], hit["position"]).alias("ord"), hit["name"].alias("name"),
        split_params(hit["params"]).alias("args"),
    ))
    py = F.transform(pattern_functions(content), lambda hit, at: F.struct(
        at.cast("long").alias("ord"), hit["name"].alias("name"), pattern_params(hit["params"]).alias("args"),
    ))
    # the plain ``inline`` would search each text once more, in a filter before it
    hits = files.filter(F.col("path").isNotNull()).select(*KEYS, language.alias("language"), content).select(
        *KEYS, "language", F.inline_outer(F.when(F.col("language") == "javascript", js).otherwise(py))
    ).filter(F.col("name").isNotNull())
    return hits.select(
        *KEYS, "ord", module_name(F.col("path")).alias("module"), "name", "language", "args",
        F.lit(None).cast("string").alias("docstring"),
        F.lit(None).cast("map<string,int>").alias("profile"),
    )


def explode_params(entities: DataFrame) -> DataFrame:
    return entities.select(
        *KEYS, "ord", "module", "name", F.posexplode("args").alias("pos", "arg")
    ).select(*KEYS, "ord", "module", "name", "pos", "arg.name", "arg.type").toDF(
        *KEYS, "ord", "module", "entity", "pos", "param", "param_type"
    )


def _optional(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _kwargs(**values: Column) -> Column:
    pairs = F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v)])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _usages(files: DataFrame, pattern: str, first: str, second: str) -> DataFrame:
    return files.select(
        *KEYS, F.posexplode(_groups(F.col("content"), pattern, first, second)).alias("ord", "hit")
    ).select(*KEYS, "ord", "hit.*")


def py_api_usage(files: DataFrame) -> DataFrame:
    """Calls of the ``requests`` API; argument text ends at the first ``)``."""
    hits = _usages(files, P.PY_REQUEST_CALL, "called", "arguments")
    arguments = F.col("arguments")
    quoted, formatted = _optional(arguments, P.PY_URL), _optional(arguments, P.PY_FORMATTED_URL)
    return hits.select(
        *KEYS,
        "ord",
        F.concat(F.lit("requests."), "called").alias("api_name"),
        F.coalesce(quoted, formatted, F.lit("")).alias("url"),
        F.lit(None).cast("string").alias("method"),
        _kwargs(timeout=_optional(arguments, P.PY_TIMEOUT)).alias("kwargs"),
    )


def js_api_usage(files: DataFrame) -> DataFrame:
    """Two-argument ``fetch`` calls with a literal address."""
    hits = _usages(files, P.JS_FETCH_CALL, "url", "options")
    options = F.col("options")
    return hits.select(
        *KEYS,
        "ord",
        F.lit("fetch").alias("api_name"),
        "url",
        F.coalesce(_optional(options, P.JS_METHOD), F.lit("GET")).alias("method"),
        _kwargs(timeout=_optional(options, P.JS_TIMEOUT)).alias("kwargs"),
    )


def extract_api_usage(files: DataFrame, api_name: str) -> DataFrame:
    """JavaScript text goes to the ``fetch`` extractor, all other text to ``requests``."""
    language = detect_language(F.col("content"))
    if api_name == "fetch":
        return js_api_usage(files.filter(language == "javascript"))
    if api_name == "requests":
        return py_api_usage(files.filter(language != "javascript"))
    return py_api_usage(files.limit(0))
