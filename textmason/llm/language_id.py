"""Language identification by the nearest centroid.

A text is a normalised TF-IDF vector over hashed letter n-grams. Each language has several
centroids, clusters of its learning texts; a text gets the language of the centroid with the
greatest cosine, its score. A text further from its centroid than nearly all learning texts of
that centroid is marked as rejected (or given as ``und``, see ``identify``).

Learning: document frequencies from all learning texts; first centroids by spherical k-means over
at most ``SAMPLE`` texts of each language (that bound is only for where clusters start); then
every learning text goes to its nearest centroid of its language, whose mean is the final
centroid, and whose distances give the bound of rejection.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and rejected, and
teaches nothing; a null lang teaches nothing; a null id counts as the text ''. Without any learning text
everything is ``und``. Ties go to the first language in byte order. Rows are judged one by one, so
repeated rows give repeated results (in learning each counts); very long texts are read whole, in
steps of ``STEP_BYTES``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmason.llm.common import add_arrays, bound_batches, tidy

UNKNOWN = "und"
#: Lengths of n-grams in bytes, and how many buckets they are hashed into.
LENGTHS, BUCKETS = (1, 2, 3), 1 << 13
#: Most texts of a language whose clusters start the centroids, and how many clusters.
SAMPLE, CLUSTERS = 1000, 4
#: Share of a centroid's learning texts that are further away than the bound of rejection.
REJECTED = 0.005
#: A model grows with its languages; more are refused.
MOST_LANGUAGES = 500
STEP_BYTES = 1 << 20
_BINS = 200
_LETTERS = bytes(b if b >= 0x80 else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256))
_ASCII_LETTER = re.compile(r"[A-Za-z]")
_SPREAD = np.uint32(2654435769)
_SHIFT = np.uint32(32 - (BUCKETS.bit_length() - 1))


# -- vectors -----------------------------------------------------------------------


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def gram_counts(raw: bytes) -> np.ndarray:
    """How often the n-grams of a text fall into each bucket; words have a blank on both sides."""
    spaced = b" " + b" ".join(raw.translate(_LETTERS).split()) + b" "
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(spaced), STEP_BYTES):
        # a step reaches into the next one by what its last n-grams need
        codes = np.frombuffer(spaced[start : start + STEP_BYTES + max(LENGTHS) - 1], np.uint8).astype(np.uint32)
        grams, own = codes, min(STEP_BYTES, len(spaced) - start)
        for length in range(1, max(LENGTHS) + 1):
            if length > 1:
                grams = grams[:-1] * np.uint32(256) + codes[length - 1 :]
            if length in LENGTHS:
                mixed = (grams[:own] + np.uint32(length << 28)) * _SPREAD
                counts += np.bincount(mixed >> _SHIFT, minlength=BUCKETS)
    return counts


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length; zero where a text has no n-grams."""
    weights = np.zeros(BUCKETS, np.float32)
    at = np.flatnonzero(counts)
    weights[at] = counts[at] * idf[at]
    length = np.sqrt((weights * weights).sum())
    return weights / length if length else weights


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(lengths > 0, lengths, 1)


def clusters(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centroids of unit vectors by spherical k-means, far ones first."""
    centroids = _unit(vectors.mean(axis=0, keepdims=True))
    for _ in range(1, k):
        nearest = (vectors @ centroids.T).max(axis=1)
        # the half-way text between the mean and the furthest is less likely to be junk
        pick = np.argsort(nearest, kind="stable")[len(vectors) // 20]
        centroids = np.vstack([centroids, vectors[pick]])
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        used = np.unique(own)
        centroids = _unit(np.stack([vectors[own == c].sum(axis=0) for c in used]))
    return centroids


# -- learning ------------------------------------------------------------------------


@dataclass
class Model:
    """Languages and bounds of the centroids, which are rows of ``centroids``."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    bounds: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of each vector."""
        cosines = vectors @ self.centroids.T
        best = cosines.argmax(axis=1)
        return best, np.clip(cosines[np.arange(len(best)), best], 0, 1)


def _texts(column: pa.Array):
    return [(text, text.encode("utf-8")) if has_letter(text) else None for text in column.to_pylist()]


def _document_frequencies(batches):
    found, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for pair in _texts(batch.column(0)):
            if pair:
                found[:BUCKETS] += gram_counts(pair[1]) > 0
                n += 1
    found[BUCKETS] = n
    yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["data"])


def _idf(learning: DataFrame) -> np.ndarray:
    partial = learning.select("text").mapInArrow(tidy(_document_frequencies), "data BINARY")
    found = add_arrays(partial.withColumn("part", F.spark_partition_id()), "i8", BUCKETS + 1)
    return (np.log((1 + found[-1]) / (1 + found[:-1])) + 1).astype(np.float32)


def _sample(learning: DataFrame, langs: dict[str, int], most: int) -> DataFrame:
    """At most ``most`` texts of each language, those with the least hashes.

    Rows that can't be among them, by the counted rows of their language, are left out before the
    rest is ranked; a hot text of one hash is cut by its rank.
    """
    share = F.create_map(*(F.lit(x) for pair in langs.items() for x in pair))[F.col("lang")]
    hashed = learning.withColumn("hash", F.xxhash64("text"))
    place = (F.col("hash") / 2.0**64 + 0.5) * share
    few = hashed.filter(place <= 4 * most + 100)
    order = Window.partitionBy("lang").orderBy("hash")
    return few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _first_centroids(learning: DataFrame, langs: dict[str, int], idf, sample: int, k: int):
    """(languages, centroids) that start the learning."""

    def sparse(batches):
        for batch in batches:
            rows = []
            for lang, pair in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if pair:
                    weights = vector(gram_counts(pair[1]), idf)
                    at = np.flatnonzero(weights)
                    rows.append((lang, at.astype("<u2").tobytes(), weights[at].tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=["lang", "at", "weights"],
            )

    def clustered(key, table):
        rows = np.zeros((len(table), BUCKETS), np.float32)
        pairs = sorted(zip(table.column("at").to_pylist(), table.column("weights").to_pylist()))
        for row, (at, weights) in zip(rows, pairs):
            row[np.frombuffer(at, "<u2")] = np.frombuffer(weights, np.float32)
        found = clusters(rows, k)
        return pa.table({"lang": [key[0].as_py()] * len(found), "data": [c.tobytes() for c in found]})

    vectors = _sample(learning, langs, sample).select("lang", "text").mapInArrow(
        tidy(sparse), "lang STRING, at BINARY, weights BINARY"
    )
    found = vectors.groupBy("lang").applyInArrow(clustered, "lang STRING, data BINARY").collect()
    found.sort(key=lambda row: (row.lang.encode(), row.data))
    centroids = [np.frombuffer(row.data, np.float32) for row in found]
    return [row.lang for row in found], np.stack(centroids) if found else np.zeros((0, BUCKETS), np.float32)


def _refined(learning: DataFrame, idf, langs: list[str], centroids: np.ndarray, rejected: float) -> Model:
    """Means and bounds of distance of the learning texts nearest to each centroid of their language."""
    wide = BUCKETS + _BINS

    def run(batches):
        total = np.zeros((len(langs), wide))
        places = {lang: np.array([k for k, x in enumerate(langs) if x == lang]) for lang in set(langs)}
        for batch in batches:
            for lang, pair in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if pair and lang in places:
                    weights = vector(gram_counts(pair[1]), idf)
                    cosines = centroids[places[lang]] @ weights
                    best = int(cosines.argmax())
                    row = total[places[lang][best]]
                    row[:BUCKETS] += weights
                    row[BUCKETS + min(_BINS - 1, max(0, int(cosines[best] * _BINS)))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    partial = learning.select("lang", "text").mapInArrow(tidy(run), "data BINARY")
    total = add_arrays(partial.withColumn("part", F.spark_partition_id()), "f8", len(langs) * wide)
    total = total.reshape(len(langs), wide)
    bins = total[:, BUCKETS:]
    used = bins.sum(axis=1) > 0
    below = np.cumsum(bins, axis=1) <= rejected * bins.sum(axis=1, keepdims=True)
    bounds = below.sum(axis=1) / _BINS
    means = _unit(total[:, :BUCKETS]).astype(np.float32)
    return Model(idf, [x for x, u in zip(langs, used) if u], means[used], bounds[used])


def learn(
    learning: DataFrame, sample: int = SAMPLE, k: int = CLUSTERS, rejected: float = REJECTED
) -> Model:
    """Model of a table of (lang, text); rows without a language teach nothing."""
    bound_batches(learning.sparkSession)
    learning = learning.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = learning.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    if not counts:
        return Model(np.ones(BUCKETS, np.float32), [], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    idf = _idf(learning)
    langs, centroids = _first_centroids(learning, {r["lang"]: r["count"] for r in counts}, idf, sample, k)
    return _refined(learning, idf, langs, centroids, rejected)


# -- prediction ------------------------------------------------------------------------


def identify(docs: DataFrame, model: Model, keep: list[Column] = (), reject: bool = False) -> DataFrame:
    """The columns of ``keep``, then (lang_pred, score, rejected) of each row's ``text``.

    With ``reject`` rejected texts are ``und`` too.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, docs["text"].cast("string").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    names = [f.name for f in rows.schema.fields[:-1]] + ["lang_pred", "score", "rejected"]

    def run(batches):
        for batch in batches:
            pairs = _texts(batch.column(batch.num_columns - 1))
            langs = [UNKNOWN] * len(pairs)
            scores, far = np.zeros(len(pairs)), np.ones(len(pairs), bool)
            known = [k for k, pair in enumerate(pairs) if pair] if model.langs else []
            for start in range(0, len(known), 256):
                part = known[start : start + 256]
                best, cosines = model.nearest(np.stack([vector(gram_counts(pairs[k][1]), model.idf) for k in part]))
                scores[part], far[part] = cosines, cosines < model.bounds[best]
                for k, c in zip(part, best):
                    langs[k] = UNKNOWN if reject and far[k] else model.langs[c]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores), pa.array(far)], names=names
            )

    return rows.mapInArrow(
        tidy(run), ", ".join([*fields, "lang_pred STRING", "score DOUBLE", "rejected BOOLEAN"])
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: a third, by the checksum of its id."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def predict_languages(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), learnt from the rows that aren't held out."""
    out = held_out(docs[id_column])
    model = learn(docs.filter(~out).select("lang", "text"))
    return identify(docs, model, [docs[id_column].cast("bigint").alias("doc_id"), out.alias("held_out")])
