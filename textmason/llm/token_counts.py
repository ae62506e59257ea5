"""Token counts of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic
programming carries the best score and the number of pieces. Among equal scores the
longest last piece wins, which is the tokenizer's own rule. A character that no piece
covers costs the lowest score less ten and counts its UTF-8 bytes if the vocabulary has
byte pieces, else each run of such characters counts one.

Vocabularies whose pieces hold the word mark only at their start split at every mark, so
words are counted once per task and remembered in a table of bounded size.

Defined cases: a null or empty text has no tokens; a very long word is counted in time
proportional to its length; repeated rows give repeated results; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from textmason.llm.common import small_bytes, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_NONE = float("-inf")
#: Words remembered per worker, and the longest of them.
MEMORY_WORDS, MEMORY_CHARS = 1 << 18, 48


class UnigramCounter:
    """Counts pieces for a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        inner = any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        lines = any("\n" in piece for piece, _ in pieces)
        if inner or not (byte_pieces or any(piece == MARK for piece, _ in pieces)):
            # a mark that is no piece by itself may be unknown, and unknown runs go on across it
            self.units = None
        elif lines or not byte_pieces:
            self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.units = re.compile(f"\n+|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        self.known: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Pieces of the best segmentation of ``text``."""
        score, count, unknown_run = [0.0], [0], [False]
        unknown, byte_pieces = self.unknown, self.byte_pieces
        best, size, covered, settled = _NONE, 0, False, 0
        # matches come by their end, the longest of an end first; a last entry settles the rest
        found = () if self.empty else self.automaton.iter(text)
        for last, (length, value) in chain(found, ((len(text), (1, 0.0)),)):
            while settled < last:  # no further match ends there
                if not covered and score[settled] + unknown > best:
                    best, is_unknown = score[settled] + unknown, True
                    if byte_pieces:
                        size = count[settled] + len(text[settled].encode("utf-8"))
                    else:
                        size = count[settled] + (0 if unknown_run[settled] else 1)
                else:
                    is_unknown = False
                score.append(best)
                count.append(size)
                unknown_run.append(is_unknown)
                best, covered = _NONE, False
                settled += 1
            start = settled + 1 - length
            total = score[start] + value
            if total > best:
                best, size = total, count[start] + 1
            if length == 1:
                covered = True
        return count[-1]

    def count(self, text: str) -> int:
        """Tokens of a text; a mark is put before it and for each space."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.units is None:
            return self.segment(marked)
        known, total = self.known, 0
        for unit in self.units.findall(marked):
            found = known.get(unit)
            if found is None:
                found = self.segment(unit)
                if len(unit) <= MEMORY_CHARS:
                    if len(known) >= MEMORY_WORDS:
                        known.clear()
                    known[unit] = found
            total += found
        return total


@lru_cache(maxsize=2)
def counter_of(model: bytes) -> UnigramCounter:
    """Counter over the pieces and scores of a model; its control and byte pieces match no text."""
    loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = loaded.get_piece_size()
    own = [
        (loaded.id_to_piece(k), float(loaded.get_score(k)))
        for k in range(size)
        if not (loaded.is_control(k) or loaded.is_unknown(k) or loaded.is_byte(k) or loaded.is_unused(k))
    ]
    return UnigramCounter(own, sum(loaded.is_byte(k) for k in range(size)) == 256)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: characters and tokens. No shuffle."""
    model = small_bytes(docs.sparkSession, model_path)

    def count(batches):
        counter = counter_of(model.value)
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(body) for body in bodies], pa.int64()),
                    pa.array([counter.count(body) for body in bodies], pa.int64()),
                ],
                names=["doc_id", "n_chars", "n_tokens"],
            )

    return texts(docs).mapInArrow(count, "doc_id BIGINT, n_chars BIGINT, n_tokens BIGINT")
