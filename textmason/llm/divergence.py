"""Source divergence audit: how far each source's use of terms is from the others of its language.

Each (lang, source) group has a segment tree of counts over the term ids of its language. Trees
are hash-consed: a subtree is named by the names of its halves, so equal runs of counts share one
node, within a group, between groups and at any place. Two trees are walked from their roots at
the same time; equal pairs of nodes of a level are met once, with the number of places where they
stand, and so each distinct pair of counts is priced once for two groups.

Term ids are dealt to blocks of ``BLOCK`` terms and groups to tiles of ``TILE`` groups; a task walks
the subtrees of one block for the groups of two tiles, whatever the number of rows. The prices of
the blocks are added up by Spark.

Defined cases: a null text has no terms; a null lang or source is ''. A group without terms still
has a tree, of zeros. A language without kept terms has value 0 for all pairs and no term rows.
Repeated rows count as documents of their own, very long texts are read whole (one text's words
are in memory at once), an empty table gives an empty result, and other columns are ignored.
Ties are ordered by the UTF-8 bytes of the item.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmason.llm.common import bound_batches, join_salted, partitions, tidy, tidy_group, utf8
from textmason.session import cut_lineage, forget

LEAST_DOCUMENTS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
#: Terms of a block (a power of two) and groups of a tile, on average.
BLOCK, TILE = 4_096, 32
#: Distinct terms that a task holds before it hands their counts on.
HELD_TERMS = 300_000

#: Bytes of terms: letters in lower case and all of UTF-8 beyond ASCII; the others part terms.
_TERMS = bytes(
    b if b >= 0x80 else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256)
)
_COUNTS = "lang STRING, source STRING, term STRING, n BIGINT, docs BIGINT"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERMS).split()


def _count_terms(batches):
    """Counts and numbers of documents for each group and term, combined within the task."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    found: dict[tuple, Counter] = defaultdict(Counter)

    def held():
        for (lang, source), terms in counts.items():
            names = list(terms)
            seen = found[lang, source]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([key] * len(names), pa.string()) for key in (lang, source)),
                 pa.array(names, pa.binary()).cast(pa.string()),
                 pa.array(list(terms.values()), pa.int64()),
                 pa.array([seen[name] for name in names], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        counts.clear()
        found.clear()

    for batch in batches:
        langs, sources = (batch.column(k).to_pylist() for k in (0, 1))
        for lang, source, raw in zip(langs, sources, utf8(batch.column(2))):
            terms = terms_of(raw)
            counts[lang, source].update(terms)
            found[lang, source].update(set(terms))
        if sum(map(len, counts.values())) > HELD_TERMS:
            yield from held()
    yield from held()


# -- trees -------------------------------------------------------------------------


def build_trees(counts: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """(count of each leaf, levels from the root down, root of each row) of rows of counts.

    A row holds a power of two of counts. A level gives the left and right child of each of its
    nodes; equal pairs of children are one node.
    """
    values, nodes = np.unique(counts, return_inverse=True)
    nodes = nodes.reshape(counts.shape)
    levels, n = [], len(values)
    while nodes.shape[1] > 1:
        pairs, named = np.unique(nodes[:, ::2] * n + nodes[:, 1::2], return_inverse=True)
        levels.append((pairs // n, pairs % n, n))
        nodes, n = named.reshape(len(counts), -1), len(pairs)
    return values, levels[::-1], nodes[:, 0]


def walk_pairs(levels: list, one: int, others: np.ndarray):
    """(other's place, node of ``one``, node of the other, times) of the distinct pairs of leaves."""
    place = np.arange(len(others))
    left, right, times = np.full(len(others), one), others, np.ones(len(others), np.int64)
    for lower, upper, n in levels:
        # both halves of each pair; pairs that are equal go on as one
        keys = np.concatenate([
            (place * n + half[left]) * n + half[right] for half in (lower, upper)
        ])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        times = np.add.reduceat(np.concatenate([times, times])[order], first)
        keys = keys[first]
        place, left, right = keys // (n * n), keys // n % n, keys % n
    return place, left, right, times


def scaled(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total), three digits at a time so that nothing overflows."""
    rest, out = counts + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def prices(counts: np.ndarray, totals: np.ndarray, rows: np.ndarray, columns: np.ndarray):
    """(row, column, price of row against column, price of column against row).

    ``counts`` has a row for each group, -1 where there is no term; ``totals`` has N + V of each
    group. Of groups in both ``rows`` and ``columns`` each pair is given once.
    """
    values, levels, roots = build_trees(counts)
    within = bool(set(rows.tolist()) & set(columns.tolist()))
    for row in rows:
        others = columns[columns > row] if within else columns
        if not len(others):
            continue
        place, left, right, times = walk_pairs(levels, roots[row], roots[others])
        real = values[left] >= 0
        place, left, right, times = place[real], left[real], right[real], times[real]
        p = scaled(values[left], totals[row])
        q = scaled(values[right], totals[others][place])
        square = (p - q) * (p - q)
        there, back = np.zeros((2, len(others)), np.int64)
        np.add.at(there, place, times * (square // q))
        np.add.at(back, place, times * (square // p))
        yield np.full(len(others), row), others, there, back


def _price_block(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Prices of one block of terms between the groups of two tiles."""
    lang, _, low, high = (k.as_py() for k in key)
    groups = groups.sort_by("source")  # a pair has the same order in every block
    names = groups.column("source").to_pylist()
    tile = groups.column("tile").to_numpy()
    totals = groups.column("total").to_numpy()
    coded = terms.column("term").combine_chunks().dictionary_encode()
    # terms of the block that none of these groups has count as 0 too; there may be no term at all
    n = groups.column("terms")[0].as_py()
    width = 1 << max(n - 1, 0).bit_length()
    counts = np.zeros((len(names), width), np.int64)
    counts[:, n:] = -1
    at = pc.index_in(terms.column("source"), pa.array(names, pa.string())).to_numpy()
    counts[at, coded.indices.to_numpy()] = terms.column("n").to_numpy()
    # terms of like frequency side by side: the rare ones share most of their nodes
    counts[:, :n] = counts[:, np.argsort(-counts[:, :n].sum(axis=0), kind="stable")]
    found = list(prices(counts, totals, np.flatnonzero(tile == low), np.flatnonzero(tile == high)))
    row, column, there, back = (
        np.concatenate(part) if found else np.zeros(0, np.int64) for part in (zip(*found) if found else [[]] * 4)
    )
    pick = pa.array(names, pa.string())
    return pa.table({
        "lang": pa.array([lang] * len(row), pa.string()), "one": pick.take(pa.array(row)),
        "other": pick.take(pa.array(column)), "there": there, "back": back,
    })


# -- tables ------------------------------------------------------------------------


def _scaled(count: str, total: str) -> Column:
    """As ``scaled``, of columns."""
    rest, out = f"({count} + 1)", "0L"
    for _ in range(3):
        out, rest = f"({out} * 1000 + {rest} * 1000 div {total})", f"({rest} * 1000 % {total})"
    return F.expr(f"{out} + 1")


def count_terms(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lang_n, leads) of the kept terms, with counts above 0.

    ``lang_n`` is the term's count in the whole language; one row of each term leads.
    """
    bound_batches(docs.sparkSession)
    read = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")))
    # dealt by term once: sums by group, and those of the language, need no further shuffle
    dealt = read.mapInArrow(tidy(_count_terms), _COUNTS).repartition(
        partitions(docs.sparkSession), "lang", "term"
    )
    of_term = Window.partitionBy("lang", "term")
    return (
        dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"),
                F.sum("n").over(of_term).alias("lang_n"),
                (F.col("source") == F.min("source").over(of_term)).alias("leads"))
        .filter(F.col("docs") >= least_documents).drop("docs")
    )


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Stored (lang, source, total, lang_total, blocks, tiles, tile) of every group; totals are N + V."""
    groups = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
                           for c in ("lang", "source"))).distinct()
    of_group = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("n"), F.count_if("leads").alias("v")
    )
    sums = cut_lineage(groups.join(of_group, ["lang", "source"], "left").fillna(0, ["n", "v"]))
    langs = sums.groupBy("lang").agg(
        F.sum("v").alias("lang_v"), F.sum("n").alias("lang_n"), F.ceil(F.count("*") / TILE).alias("tiles")
    )
    sized = cut_lineage(sums.join(langs, "lang").select(
        "lang", "source", F.expr("n + lang_v").alias("total"), F.expr("lang_n + lang_v").alias("lang_total"),
        F.greatest(F.ceil(F.col("lang_v") / BLOCK), F.lit(1)).cast("int").alias("blocks"),
        F.col("tiles").cast("int").alias("tiles"),
        F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"),
    ))
    forget(sums)
    return sized


def _cells(rows: DataFrame) -> DataFrame:
    """Rows repeated for each pair of tiles that theirs is part of."""
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return rows.withColumn("with", other).withColumns({
        "low": F.least("tile", "with"), "high": F.greatest("tile", "with"),
    }).drop("with", "tiles")


def _pairs(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    cell = ["lang", "block", "low", "high"]
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    terms = _cells(dealt.select("lang", "source", "term", "n", "tile", "tiles", "block")).drop("tile")
    of_block = dealt.groupBy("lang", "block").agg(F.count_if("leads").cast("int").alias("terms"))
    groups = _cells(
        sizes.select(
            "lang", "source", "total", "tile", "tiles",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        ).join(of_block, ["lang", "block"], "left").fillna(0, ["terms"])
    )
    priced = terms.groupBy(*cell).cogroup(groups.groupBy(*cell)).applyInArrow(
        tidy_group(_price_block), "lang STRING, one STRING, other STRING, there BIGINT, back BIGINT"
    )
    both = F.inline(F.array(
        F.struct(F.col("one").alias("source"), F.col("other").alias("item"), F.col("there").alias("value")),
        F.struct(F.col("other").alias("source"), F.col("one").alias("item"), F.col("back").alias("value")),
    ))
    summed = priced.groupBy("lang", "one", "other").agg(
        F.sum("there").alias("there"), F.sum("back").alias("back")
    )
    return summed.select("lang", both)


def source_divergence(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language, with the chi-square distance of the smoothed
    shares of terms. Part ``term``: the ``top_terms`` terms that the source uses most above its
    language.
    """
    kept = cut_lineage(count_terms(docs, least_documents))
    sizes = group_sizes(docs, kept)
    counted = join_salted(kept, sizes, ["lang", "source"], F.col("term"))
    terms = (
        counted.withColumns({"p": _scaled("n", "total"), "q": _scaled("lang_n", "lang_total")})
        .filter("p > q")
        .select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    )
    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def part(rows: DataFrame, name: str) -> DataFrame:
        ranked = rows.withColumn("rank", F.row_number().over(falling))
        return ranked.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(_pairs(counted, sizes), "pair").unionByName(
        part(terms, "term").filter(F.col("rank") <= top_terms)
    )


ORACLE = rf"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), used AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM docs)
  GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM docs)
  JOIN used USING (lang, term) GROUP BY ALL
), whole AS (
  SELECT lang, term, sum(n) AS lang_n FROM counted GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS n FROM whole GROUP BY lang
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, w.term, coalesce(c.n, 0) AS n,
    1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + l.v) AS p,
    1 + {SCALE}::HUGEINT * (w.lang_n + 1) // (l.n + l.v) AS q
  FROM sizes s JOIN whole w ON s.lang = w.lang JOIN langs l ON s.lang = l.lang
  LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = w.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
