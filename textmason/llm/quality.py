"""Quality rules by repetition coverage.

Rolling hashes over the words of a text find the n-grams of several lengths that occur
earlier in it; what counts is how many characters lie inside such repeats, and inside
repeated lines.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; a
text shorter than an n-gram has no repeats of that length; rows are judged one by one, so
repeated rows give repeated results; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmason.llm.common import texts, tidy, utf8

#: Largest share (percent) of word characters inside repeated n-grams, by length.
MOST_REPEATED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Largest share (percent) of word characters inside repeated lines.
MOST_LINES = 20
BASE_WINDOW, BASE_PERCENT, BASE_WORDS = 8, 30, 20
SYMBOLS = b"#*$%&|<>"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    *(f"chars_{n}" for n in MOST_REPEATED), "line_chars",
)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(codes: np.ndarray, lengths):
    """For each length: (length, groups of equal windows as sorted starts, same-as-before)."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    mixed ^= mixed >> np.uint64(29)
    hashes, size = mixed, 1
    for length in sorted(lengths):
        if length > len(codes):
            break
        while size < length:
            hashes = hashes[:-1] * _BASE + mixed[size:]
            size += 1
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        pairs = np.flatnonzero(same)
        before, after = order[pairs], order[pairs + 1]
        if any((codes[before + k] != codes[after + k]).any() for k in range(length)):
            # two different windows share a hash: name the windows themselves
            rows = np.lib.stride_tricks.sliding_window_view(codes, length)
            names = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
            order = np.argsort(names, kind="stable")
            same = names[order][1:] == names[order][:-1]
        yield length, order, same


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in windows of ``length`` words at ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(raw: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = raw.split()  # bytes split at the six ASCII blanks
    n = len(words)
    symbols = sum(raw.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))
    if not n:
        return (0, 0, symbols, *[0] * (len(COUNTS) - 3))
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    chars = np.add.reduceat((~blank & ((data & 0xC0) != 0x80)).astype(np.int64), starts)
    found = dict.fromkeys(COUNTS, 0)
    for length, order, same in _windows(codes, {BASE_WINDOW, *MOST_REPEATED}):
        if not same.any():
            break  # a longer window can't repeat where a shorter one doesn't
        later = order[1:][same]
        if length in MOST_REPEATED:
            found[f"chars_{length}"] = int(chars[_covered(later, length, n)].sum())
        if length == BASE_WINDOW:
            every = np.concatenate((order[:-1][same], later))
            found["n_repeat_words"] = int(_covered(np.unique(every), length, n).sum())
    lines: set[bytes] = set()
    repeated = []
    for line in raw.split(b"\n"):
        if line.strip():
            if line in lines:
                repeated.append(line)
            lines.add(line)
    found["n_dup_lines"] = len(repeated)
    found["line_chars"] = sum(len(b"".join(x.split()).decode("utf-8")) for x in repeated)
    found |= {"n_words": n, "word_chars": int(chars.sum()), "n_symbols": symbols}
    return tuple(found[name] for name in COUNTS)


def _measure(batches):
    """Rows are (doc_id, text) or (doc_id, whole row)."""
    for batch in batches:
        body, name = batch.column(1), batch.schema.names[1]
        carried = pa.types.is_struct(body.type)
        bodies = utf8(pc.struct_field(body, "text") if carried else body)
        counted = [measure(raw) for raw in bodies]
        columns = zip(*counted) if counted else [[] for _ in COUNTS]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), *[body] * carried],
            names=["doc_id", *COUNTS, *[name] * carried],
        )


def repetition_quality(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Counts per document, ``base_failed`` and the verdict ``kept``. No shuffle.

    With ``carry`` also ``rest``, the whole input row as a struct.
    """
    schema = "doc_id BIGINT, " + ", ".join(f"{name} BIGINT" for name in COUNTS)
    rows = texts(docs, carry=carry)
    if carry:
        schema += f", rest {rows.schema['rest'].dataType.simpleString()}"
        rows = rows.select("doc_id", "rest")
    counted = rows.mapInArrow(tidy(_measure), schema)
    failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words")
    )
    fine = 100 * F.col("line_chars") <= MOST_LINES * F.col("word_chars")
    for length, percent in MOST_REPEATED.items():
        fine &= 100 * F.col(f"chars_{length}") <= percent * F.col("word_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def _cover_sql(n: int) -> str:
    """Per document: words in windows of ``n`` found twice, and characters in later ones."""
    return f"""
grams{n} AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, gram ORDER BY s) AS k,
    count(*) OVER (PARTITION BY doc_id, gram) AS n
  FROM (SELECT doc_id, unnest(range(1, len(words) - {n} + 2)) AS s,
          array_to_string(list_slice(words, s, s + {n} - 1), ' ') AS gram
        FROM split WHERE len(words) >= {n})
), cover{n} AS (
  SELECT g.doc_id, count(*) AS n_words, coalesce(sum(length(split.words[i])) FILTER (later), 0) AS chars
  FROM (SELECT doc_id, i, bool_or(k > 1) AS later
        FROM (SELECT doc_id, k, unnest(range(s, s + {n})) AS i FROM grams{n} WHERE n > 1)
        GROUP BY ALL) g JOIN split USING (doc_id) GROUP BY g.doc_id
)"""


ORACLE = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), {",".join(_cover_sql(n) for n in sorted({BASE_WINDOW, *MOST_REPEATED}))},
lines AS (
  SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(cover{BASE_WINDOW}.n_words, 0) AS n_repeat_words,
    {" ".join(f"coalesce(cover{n}.chars, 0) AS chars_{n}," for n in MOST_REPEATED)}
    coalesce(lines.chars, 0) AS line_chars
  FROM split s LEFT JOIN lines USING (doc_id)
  {" ".join(f"LEFT JOIN cover{n} USING (doc_id)" for n in MOST_REPEATED)}
)
SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
  NOT (n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words)
    AND 100 * line_chars <= {MOST_LINES} * word_chars
    {" ".join(f"AND 100 * chars_{n} <= {p} * word_chars" for n, p in MOST_REPEATED.items())} AS kept
FROM counted
"""
