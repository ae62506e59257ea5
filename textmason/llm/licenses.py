"""Licence scan: known licence sentences first, then ordered rules over their identifiers.

A text is cut at the ends of its sentences and normalised (A-Z in lower case, runs of other
ASCII characters than letters and digits become one space; so does a line break inside a
sentence, with the mark of a comment that follows it). Known sentences are sought as whole
words anywhere between two ends, from left to right, the longest first; none overlap. A rule
names the identifiers a licence consists of, in order; other sentences may lie between.
Everything happens inside the document's row: no join and no shuffle.

Defined cases: a null or empty text has no sentence and no licence; repeated sentences keep
all their places; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.llm.common import ascii_lower, texts

# fixed values: licence sentences, normalised
SENTENCES = {
    "mit-name": "the mit license",
    "mit-title": "mit license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2-licensed": "licensed under the apache license version 2 0",
    "apache-2-licensed-the-license": "licensed under the apache license version 2 0 the license",
    "apache-2-title": "apache license version 2 0",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3-licensed": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl-3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-work": "this work is dedicated to the public domain under cc0 1 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "rights-reserved": "all rights reserved",
}
# fixed values: ordered rules; the identifiers must occur in this order
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title", "mit-grant")),
    ("Apache-2.0", ("apache-2-licensed-the-license", "apache-comply", "apache-obtain")),
    ("Apache-2.0", ("apache-2-licensed",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2-later", "gpl-hope")),
    ("GPL-3.0", ("gpl-3-work",)),
    ("GPL-3.0", ("gpl-3-licensed",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC0-1.0", ("cc0-work",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Proprietary", ("rights-reserved",)),
)
#: Where the checking SQL ends a sentence: at every line end too, and it seeks whole sentences
#: only. It gives the same rows where no known sentence is wrapped or has words around it.
END = r"[.!?;:][ \t\r\n]+|[\r\n]+"
#: What separates words: ASCII other than letters and digits, but for the mark of an end.
GAP = r"[\x00-\x1E\x20-\x2F\x3A-\x60\x7B-\x7F]+"
#: A sentence ends at one of these marks and a blank, at a blank line (of a comment, too) and
#: before an item of a list. GPL 2 has a semicolon inside the sentence that names its version.
SENTENCE_END = (
    r"[.!?][ \t\r\n]+|(?>\r\n|[\r\n])[ \t*#/;>|]*(?:-*[ \t]*[\r\n]"
    r"|(?:[-+\u2022]|\(?(?:[0-9]{1,3}|[A-Za-z]|[ivx]{1,5})[.)])[ \t])"
)


def normalised(text: Column) -> Column:
    """The words of a text, one space between them, and a mark at each end of a sentence."""
    return F.regexp_replace(ascii_lower(F.regexp_replace(text, SENTENCE_END, "\x1f")), GAP, " ")


def _any_of(sentences: list[list[str]]) -> str:
    """Pattern of the longest of some lists of words, by their common beginnings."""
    by_word: dict[str, list[list[str]]] = {}
    for first, *rest in filter(None, sentences):
        by_word.setdefault(first, []).append(rest)
    ways = []
    for word, rests in by_word.items():
        more = _any_of(rests)
        if more:
            more = f"(?: {more})" + ("?" if [] in rests else "")
        ways.append(re.escape(word) + more)
    return f"(?:{'|'.join(ways)})" if len(ways) > 1 else "".join(ways)


def _known_pattern(known: dict[str, str]) -> str:
    words = _any_of([text.split(" ") for text in known.values()])
    return rf"(?<![^ \x1f]){words}(?![^ \x1f])"


def _rule_pattern(identifiers: tuple[str, ...]) -> str:
    return "," + ",([^ ]*,)?".join(identifiers) + ","


def scan_licenses(docs: DataFrame, known=None, rules=RULES) -> DataFrame:
    """Per document: identifiers found, in order, and the licences whose rules they meet.

    ``known`` maps an identifier to its normalised sentence; it is configuration and
    becomes a constant of the plan.
    """
    known = SENTENCES if known is None else known
    by_text = F.create_map(*(F.lit(x) for name, text in known.items() for x in (text, name)))
    found = F.transform(
        F.regexp_extract_all(normalised(F.col("text")), F.lit(_known_pattern(known)), F.lit(0)),
        lambda s: by_text[s],
    )
    rows = texts(docs).select("doc_id", F.array_join(found, ",").alias("sentence_ids"))
    chain = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    met = [F.when(chain.rlike(_rule_pattern(ids)), name) for name, ids in rules]
    return rows.select(
        "doc_id", "sentence_ids",
        F.when(F.col("sentence_ids") == "", 0)
        .otherwise(F.size(F.split("sentence_ids", ","))).cast("bigint").alias("n_sentences"),
        F.array_join(F.array_distinct(F.array_compact(F.array(*met))), ",").alias("licenses"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KEYS = ", ".join(_quoted(text) for text in SENTENCES.values())
_NAMES = ", ".join(_quoted(name) for name in SENTENCES)
ORACLE = f"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(translate(
      regexp_replace(coalesce(text, ''), '{END}', chr(31), 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}', ' ', 'g'), chr(31)) AS parts
  FROM documents
), found AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s:
    [{_NAMES}][list_position([{_KEYS}], trim(s))]), lambda x: x IS NOT NULL) AS ids FROM cut
), chained AS (
  SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, len(ids) AS n_sentences FROM found
)
SELECT doc_id, sentence_ids, n_sentences,
  array_to_string(list_filter([{", ".join(
      f"CASE WHEN {' AND '.join([f'regexp_matches(c, {_quoted(_rule_pattern(ids))})'] + [f'NOT regexp_matches(c, {_quoted(_rule_pattern(other))})' for earlier, other in RULES[:k] if earlier == name])} THEN {_quoted(name)} END"
      for k, (name, ids) in enumerate(RULES))}], lambda x: x IS NOT NULL), ',') AS licenses
FROM (SELECT *, ',' || sentence_ids || ',' AS c FROM chained)
"""
