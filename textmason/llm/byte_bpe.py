"""Byte-level BPE encoding and decoding.

Pre-tokens are merged with a queue over merge ranks: one bucket of list positions per rank,
and a bitmap of two levels whose lowest set bit is the next rank. Entries whose pair has
changed are skipped when they come up. The distinct unknown pre-tokens of some megabytes of text
share one queue: a bucket then holds positions of many pre-tokens, of which each merges its first
one, all at once. A pre-token of more than ``SHARED_BYTES`` bytes has a queue of its own, so that
one of n bytes takes n log n steps however long it is. Ids of short pre-tokens are remembered in
two generations of bounded size.

Defined cases: a null or empty text has no ids; repeated rows give repeated results; a very long
text is split and encoded in steps of ``STEP_TOKENS`` pre-tokens and decoded in steps of
``STEP_IDS`` ids; an empty table gives an empty result; other columns of the input are ignored; a
vocabulary that lacks a byte fails on texts that hold it.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textmason.llm.common import gather, small_bytes, texts, tidy

#: Pre-tokens of one of a worker's two generations of memory, and the longest of them in characters.
MEMORY_TOKENS, MEMORY_CHARS = 1 << 18, 48
#: Longest pre-token, in bytes, that shares a queue with others.
SHARED_BYTES = 256
#: Pre-tokens split from texts at once, and ids decoded at once.
STEP_TOKENS, STEP_IDS = 1 << 18, 1 << 18
#: A word of the bitmap has 2 ** WORD_BITS bits.
WORD_BITS = 8
_IN_WORD = (1 << WORD_BITS) - 1
_BIT = [1 << k for k in range(1 << WORD_BITS)]
_NONE = -1
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class RankQueue:
    """Buckets of positions by rank; the lowest rank comes first, in it the lowest position.

    ``words`` has a bit for each rank with a bucket, ``top`` a bit for each word that isn't 0.
    """

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> WORD_BITS) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def _open(self, rank: int, first) -> None:
        self.buckets[rank] = [first]
        word = rank >> WORD_BITS
        self.words[word] |= _BIT[rank & _IN_WORD]
        self.top |= 1 << word

    def _lowest(self) -> int:
        word = (self.top & -self.top).bit_length() - 1
        ranks = self.words[word]
        return (word << WORD_BITS) + (ranks & -ranks).bit_length() - 1

    def _close(self, rank: int) -> None:
        del self.buckets[rank]
        word = rank >> WORD_BITS
        self.words[word] ^= _BIT[rank & _IN_WORD]
        if not self.words[word]:
            self.top ^= 1 << word

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self._open(rank, position)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        rank = self._lowest()
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        self._close(rank)
        return rank, bucket[0]

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Arrays of positions into the buckets of their ranks; such a bucket holds arrays only."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        ends = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
        start = 0
        for end in [*ends, len(ranks)]:
            rank, some = int(ranks[start]), positions[start:end]
            bucket = self.buckets.get(rank)
            if bucket is None:
                self._open(rank, some)
            else:
                bucket.append(some)
            start = end

    def pop_all(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and all positions of its bucket, in order."""
        if not self.top:
            return None
        rank = self._lowest()
        bucket = self.buckets[rank]
        self._close(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.sort(np.concatenate(bucket))


class Vocabulary:
    """The ranks as arrays: ids of bytes, ranks of pairs of parts, and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        self.of_byte = np.array([ranks.get(bytes([b]), self.size) for b in range(256)])
        pairs = [
            ((left * (self.size + 1)) + right, rank)
            for piece, rank in ranks.items() for k in range(1, len(piece))
            if (left := ranks.get(piece[:k])) is not None and (right := ranks.get(piece[k:])) is not None
        ]
        pairs.sort()
        self.pairs = np.array([pair for pair, _ in pairs] + [np.iinfo(np.int64).max])
        self.merged = np.array([rank for _, rank in pairs] + [_NONE])
        self.lengths = np.zeros(self.size, np.int64)
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)
        self.starts = np.cumsum(self.lengths) - self.lengths
        in_order = sorted(ranks.items(), key=lambda entry: entry[1])
        self.bytes = np.frombuffer(b"".join(piece for piece, _ in in_order), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of two parts as one, where the vocabulary has it; ``size`` is no part."""
        keys = left * (self.size + 1) + right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.merged[at], _NONE)


class ByteBpe:
    """Encoder and decoder for one table of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.vocabulary = Vocabulary(ranks)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank_of, queue = len(piece), self.ranks.get, RankQueue(self.vocabulary.size)
        push, pop = queue.push, queue.pop
        after = list(range(1, n + 1))  # first byte of the next part; n ends the list
        before = list(range(-1, n - 1))
        pair = [rank_of(piece[k : k + 2], _NONE) for k in range(n - 1)]
        pair.append(_NONE)
        for position, rank in enumerate(pair):
            if rank != _NONE:
                push(rank, position)
        while (found := pop()) is not None:
            rank, left = found
            if pair[left] != rank:
                continue  # the pair has changed since
            right = after[left]
            pair[right] = _NONE
            after[left] = end = after[right]
            if end < n:
                before[end] = left
                pair[left] = new = rank_of(piece[left : after[end]], _NONE)
                if new != _NONE:
                    push(new, left)
            else:
                pair[left] = _NONE
            previous = before[left]
            if previous >= 0:
                pair[previous] = new = rank_of(piece[previous:end], _NONE)
                if new != _NONE:
                    push(new, previous)
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens that share one queue; a position lies in one of them."""
        none, rank_of = self.vocabulary.size, self.vocabulary.rank
        data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1) - 1  # the place after a pre-token parts it from the next
        part = self.vocabulary.of_byte[data]
        if (part == none).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        part[ends] = none
        token = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths + 1)
        after = np.arange(1, len(data) + 1, dtype=np.int32)
        before = np.arange(-1, len(data) - 1, dtype=np.int32)
        pair = np.append(rank_of(part[:-1], part[1:]), _NONE).astype(np.int32)
        alive = part != none
        queue = RankQueue(none)
        some = np.flatnonzero(pair != _NONE)
        if len(some):
            queue.push_all(pair[some], some)
        while (found := queue.pop_all()) is not None:
            rank, left = found
            left = left[pair[left] == rank]  # the pairs of others have changed since
            if not len(left):
                continue
            # the first place of each pre-token; a lower rank may come up before its others
            first = np.concatenate(([True], token[left[1:]] != token[left[:-1]]))
            if not first.all():
                later = left[~first]
                queue.push_all(np.full(len(later), rank), later)
                left = left[first]
            right = after[left]
            end = after[right]
            part[left], pair[right], alive[right] = rank, _NONE, False
            after[left], before[end] = end, left
            previous = before[left]  # at a start, the place that ends the pre-token before
            changed = np.concatenate([left, previous])
            pair[changed] = new = rank_of(part[changed], np.concatenate([part[end], part[left]]))
            some = np.flatnonzero(new != _NONE)
            if len(some):
                queue.push_all(new[some], changed[some])
        packed = part[alive].astype("<u4").tobytes()
        cuts = np.concatenate(([0], 4 * np.cumsum(np.bincount(token[alive], minlength=len(pieces))))).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def forget(self) -> None:
        """Drop what is remembered; a worker lives on after its task, and others need the memory."""
        self.known, self.before = {}, {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()

    def _remember(self, tokens: set[str]) -> dict[str, bytes]:
        """Ids of those of ``tokens`` that stay in no memory; the others are in ``known`` then."""
        known = self.known
        if len(known) >= MEMORY_TOKENS:
            known, self.before = {}, known
            self.known = known
        for token in [token for token in tokens if token not in known]:
            ids = self.before.get(token)
            if ids is not None:
                known[token] = ids
        unknown = [token for token in tokens if token not in known]
        pieces = [token.encode("utf-8") for token in unknown]
        shared = [k for k, piece in enumerate(pieces) if len(piece) <= SHARED_BYTES]
        rare = {
            token: self._packed(self.merge(piece))
            for token, piece in zip(unknown, pieces) if len(piece) > SHARED_BYTES
        }
        for k, ids in zip(shared, self.merge_all([pieces[k] for k in shared]) if shared else ()):
            (known if len(unknown[k]) <= MEMORY_CHARS else rare)[unknown[k]] = ids
        return rare

    def _steps(self, texts: list[str]):
        """(place of the text, some of its pre-tokens) in steps of bounded size."""
        for place, text in enumerate(texts):
            if len(text) <= STEP_TOKENS:
                yield place, self.pattern.findall(text)
            else:
                found = (match.group() for match in self.pattern.finditer(text))
                while tokens := list(islice(found, STEP_TOKENS)):
                    yield place, tokens

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0

        def settle():
            rare = self._remember({token for _, tokens in held for token in tokens})
            table = {**self.known, **rare} if rare else self.known
            for place, tokens in held:
                out[place].append(b"".join(map(table.__getitem__, tokens)))

        for step in self._steps(texts):
            held.append(step)
            size += len(step[1])
            if size >= STEP_TOKENS:
                settle()
                held, size = [], 0
        settle()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, gathered from one table."""
        numbers, table = np.frombuffer(ids, "<u4"), self.vocabulary
        return b"".join(
            table.bytes[gather(table.starts[part], table.lengths[part])].tobytes()
            for part in (numbers[k : k + STEP_IDS] for k in range(0, len(numbers), STEP_IDS))
        )


@lru_cache(maxsize=2)
def codec_of(ranks: bytes, pattern: str) -> ByteBpe:
    table = {}
    for line in ranks.splitlines():
        if line:
            piece, rank = line.split()
            table[base64.b64decode(piece)] = int(rank)
    return ByteBpe(table, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids of each text as little-endian unsigned 32-bit integers. No shuffle."""
    ranks = small_bytes(docs.sparkSession, ranks_path)

    def encode(batches):
        codec = codec_of(ranks.value, pattern)
        for batch in batches:
            ids = codec.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
            )
        codec.forget()

    return texts(docs).mapInArrow(tidy(encode), "doc_id BIGINT, ids BINARY")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids of each row stand for; null ids are none."""
    ranks = small_bytes(encoded.sparkSession, ranks_path)

    def decode(batches):
        codec = codec_of(ranks.value, pattern)
        for batch in batches:
            bodies = [codec.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bodies, pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        decode, "doc_id BIGINT, ids BINARY, decoded BINARY"
    )


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, their SHA-256, and the SHA-256 of the decoded bytes."""
    ranks = small_bytes(docs.sparkSession, ranks_path)

    def both(batches):
        codec = codec_of(ranks.value, pattern)
        for batch in batches:
            rows = []
            for ids in codec.encode_all(batch.column(1).to_pylist()):
                rows.append((
                    len(ids) // 4,
                    hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(codec.decode(ids)).hexdigest(),
                ))
            n, of_ids, of_bytes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.forget()

    return texts(docs).mapInArrow(
        tidy(both), "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"
    )
