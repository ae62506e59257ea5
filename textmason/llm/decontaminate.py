"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (the whole item if it has
fewer). Of each window, in items and in documents, the k-gram with the least hash is kept;
equal windows keep equal k-grams, so joining the kept ones finds every shared window. Each
hit is then extended: the windows around it are compared word by word.

Fingerprints and extension stay in the document's row; benchmark fingerprints are sent to
all executors in blocks of checked size, so documents are never shuffled. One pass over the
documents serves each block.

Defined cases: a null or empty text has no words; an item without words has no window;
rows with equal doc_id are separate documents, and fully repeated rows give repeated
results; an item without item_id marks words but isn't listed; equal items are all listed;
an empty documents table gives an empty result, an empty benchmark leaves all documents
clean; other columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.llm.common import BROADCAST_BYTES, ascii_lower, texts

WINDOW, GRAM = 10, 5
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A kept k-gram is one number: 33 bits of hash above 31 bits of position.
_PLACE = (1 << 31) - 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")


def kept_grams(words: str, window: int) -> Column:
    """Numbers of the least k-gram of every window of the array column ``words``."""
    gram = min(GRAM, window)
    each = window - gram + 1  # k-grams in a window
    n = F.size(words)

    def number(at: Column) -> Column:
        hashed = F.xxhash64(F.lit(window), *(F.get(F.col(words), at + k) for k in range(gram)))
        return hashed.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(at.cast("bigint"))

    none = F.array().cast("array<bigint>")
    numbers = F.when(n < window, none).otherwise(
        F.transform(F.sequence(F.lit(0), n - gram), number)
    )
    if each == 1:
        return numbers
    # bind the numbers to a name, so that they are computed once for a row
    return F.flatten(F.transform(F.array(numbers), lambda a: F.when(n < window, none).otherwise(
        F.array_distinct(F.transform(
            F.sequence(F.lit(0), n - window),
            lambda i: F.least(*(F.get(a, i + k) for k in range(each))),
        ))
    )))


def _grams(lengths: list[int]) -> Column:
    """All kept k-grams of a row as (window, number), for windows of the given lengths."""

    def tagged(length: int) -> Column:
        return F.transform(
            kept_grams("words", length),
            lambda x: F.struct(F.lit(length).alias("window"), x.alias("number")),
        )

    return F.concat(*map(tagged, lengths))


def _place(number: str) -> Column:
    return F.col(number).bitwiseAND(F.lit(_PLACE)).cast("int")


def benchmark_fingerprints(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """Kept k-grams of the items with the words around them, and the window lengths in use."""
    items = texts(benchmark, "item_id").select(
        F.col("doc_id").alias("item_id"), words_of(F.col("text")).alias("words")
    ).filter(F.size("words") > 0).withColumn("window", F.least(F.size("words"), F.lit(WINDOW)))
    lengths = sorted(r[0] for r in items.select("window").distinct().collect())  # at most WINDOW values
    found = [
        items.filter(F.col("window") == length)
        .withColumn("number", F.explode_outer(kept_grams("words", length)))
        for length in lengths
    ]
    if not found:  # no item has words, and so no row is left
        found = [items.withColumn("number", F.lit(0).cast("bigint"))]
    rows = reduce(DataFrame.unionAll, found).withColumn("at", _place("number"))
    first = F.greatest(F.col("at") - F.col("window"), F.lit(0))
    return rows.select(
        "item_id", "window", F.col("number").bitwiseAND(F.lit(~_PLACE)).alias("hash"),
        F.slice("words", first + 1, 2 * F.col("window") + GRAM).alias("around"),
        (F.col("at") - first).alias("item_at"),
    ), lengths


def _extended() -> Column:
    """Starts of the document's windows that hold the hit and equal the item's."""
    back = F.sequence(F.lit(0), F.col("window") - F.least(F.col("window"), F.lit(GRAM)))
    return F.transform(
        F.filter(back, lambda o: (
            (F.col("at") >= o) & (F.col("item_at") >= o)
            & (F.col("at") - o + F.col("window") <= F.size("words"))
            & (F.col("item_at") - o + F.col("window") <= F.size("around"))
            & (F.slice("words", F.greatest(F.col("at") - o, F.lit(0)) + 1, F.col("window"))
               == F.slice("around", F.greatest(F.col("item_at") - o, F.lit(0)) + 1, F.col("window")))
        )),
        lambda o: F.col("at") - o,
    )


def broadcast_blocks(fingerprints: DataFrame) -> tuple[DataFrame, int]:
    """(fingerprints with their ``block``, number of blocks); a block has ``BROADCAST_BYTES`` at most.

    Rows are dealt by all they hold, so that no hash, window or item can fill a block; their bytes
    are counted. Only a single row beyond that size would still be sent whole.
    """
    rows = fingerprints.distinct().withColumns({
        "bytes": F.octet_length(F.array_join("around", " ")) + 128,
        "deal": F.xxhash64("hash", "window", "item_id", "item_at", "around"),
    })
    size, n = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(size) // BROADCAST_BYTES))
    while blocks > 1:
        dealt = rows.groupBy(F.pmod("deal", F.lit(blocks))).agg(F.sum("bytes").alias("bytes"))
        if dealt.agg(F.max("bytes")).first()[0] <= BROADCAST_BYTES or blocks > 4 * n:
            break
        blocks = blocks * 3 // 2 + 1
    return rows.withColumn("block", F.pmod("deal", F.lit(blocks))).drop("deal", "bytes"), blocks


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated.

    Each block of the benchmark is a pass over all documents: a benchmark whose fingerprints take
    k times ``BROADCAST_BYTES`` takes about k passes.
    """
    rows = texts(docs).select(
        "doc_id", F.xxhash64("text").alias("body"), words_of(F.col("text")).alias("words")
    )
    fingerprints, lengths = benchmark_fingerprints(benchmark)
    fingerprints, blocks = broadcast_blocks(fingerprints)
    found = []
    for block in range(blocks):
        some = fingerprints.filter(F.col("block") == block).drop("block")
        none = F.array(F.lit(None).cast("struct<window:int,number:bigint>"))
        grams = F.concat(none, _grams(lengths)) if lengths else none  # null: the document itself
        hits = (
            rows.withColumn("grams", grams)
            # outer, though no row is empty: else a filter on the whole expression is inferred
            .select("doc_id", "body", "words", F.explode_outer("grams").alias("gram"))
            .select("doc_id", "body", "words", F.col("gram.number").alias("number"),
                    F.col("gram.window").alias("of"))
            .withColumn("key", F.col("number").bitwiseAND(F.lit(~_PLACE)))
        )
        hits = hits.join(
            F.broadcast(some),
            (F.col("key") == F.col("hash")) & (F.col("of") == F.col("window")), "left",
        ).filter(F.col("number").isNull() | F.col("hash").isNotNull()).withColumn("at", _place("number"))
        found.append(hits.select(
            "doc_id", "body", F.size("words").cast("bigint").alias("n_words"), "item_id", "window",
            (F.col("number").isNull() & F.lit(block == 0)).alias("is_row"),
            F.explode_outer(F.when(F.col("hash").isNotNull(), _extended())).alias("start"),
        ))
    spans = reduce(DataFrame.unionAll, found)
    hit = F.when(F.col("start").isNotNull(), F.struct("start", "window"))
    grouped = spans.groupBy("doc_id", "body").agg(
        F.max("n_words").alias("n_words"), F.count_if("is_row").alias("copies"),
        F.collect_set(hit).alias("spans"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.col("item_id").cast("string"))).alias("items"),
    )
    joined = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("reach")),
        lambda acc, x: F.struct(
            (acc["total"] + F.greatest(
                x["start"] + x["window"] - F.greatest(acc["reach"], x["start"]), F.lit(0)
            )).cast("bigint").alias("total"),
            F.greatest(acc["reach"], x["start"] + x["window"]).alias("reach"),
        ),
        lambda acc: acc["total"],
    )
    result = grouped.select(
        "doc_id", "n_words", joined.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"), "body",
    )
    return result.drop("_copy").withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s
        FROM (SELECT *, least(len(w), {WINDOW}) AS size FROM items WHERE len(w) > 0))
), places AS (
  SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
        FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, s, p.size, item_id FROM places p JOIN windows x ON p.size = x.size AND p.words = x.words
), hit_words AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS i FROM hits)
  GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n,
    array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY doc_id
)
SELECT words.doc_id, len(w) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(hit_items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
