"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks. Level k of a shard holds the k-th chunk of every id that
has one, a bitmap tells whether the id goes on at the next level, and a rank directory
counts the set bits before each block of 512; so any id is found without decoding others.

A shard is one value of a stored table: Spark commits whole tasks, and a lost executor
leaves no half-written file.

Defined cases: a null or empty text holds the end id only; rows are written in ascending
doc_id (null first), those with equal doc_id by text; repeated rows are written each; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import os
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmason.llm.common import partitions, small_bytes, texts, utf8
from textmason.session import cut_lineage

MAGIC = b"DAC1"
BLOCK = 512
#: A shard is closed at the first document end beyond so many ids.
SHARD_IDS = 1 << 20
#: Words remembered per worker, and the longest of them in bytes.
MEMORY_WORDS, MEMORY_BYTES = 3 << 19, 48


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned 32-bit) as one code."""
    rest = np.ascontiguousarray(ids, np.uint32)
    levels = []
    while True:
        chunks = (rest & np.uint32(0xFF)).astype(np.uint8)
        rest = rest >> np.uint32(8)
        more = rest != 0
        levels.append((chunks, more))
        if not more.any():
            break
        rest = rest[more]
    parts = [MAGIC, np.array([len(levels)], "<u4").tobytes()]
    for chunks, more in levels:
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, np.int64)
        padded[: len(more)] = more
        per_block = padded.reshape(-1, BLOCK).sum(axis=1)
        directory = np.concatenate(([0], np.cumsum(per_block))).astype("<u4")
        parts += [np.array([len(chunks)], "<u4").tobytes(), chunks.tobytes(),
                  bits.tobytes(), directory.tobytes()]
    return b"".join(parts)


class TokenShard:
    """Reader of one code."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no directly addressable code")
        self.levels = []
        at = 8
        for _ in range(int(np.frombuffer(data, "<u4", 1, 4)[0])):
            n = int(np.frombuffer(data, "<u4", 1, at)[0])
            at += 4
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bits)
            directory = np.frombuffer(data, "<u4", -(-n // BLOCK) + 1, at)
            at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, index: int) -> int:
        """The id at ``index``; one rank query for each further chunk."""
        if not 0 <= index < len(self):
            raise IndexError(index)
        value, shift = 0, 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[index]) << shift
            if not bits[index >> 3] >> (index & 7) & 1:
                break
            block = index // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8 : (index >> 3) + 1], bitorder="little")
            index = int(directory[block]) + int(inside[: index - block * BLOCK].sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level from the last."""
        values = None
        for chunks, bits, _ in reversed(self.levels):
            whole = chunks.astype(np.uint32)
            if values is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                whole[more] |= values << np.uint32(8)
            values = whole
        return values


def _byte_letters() -> str:
    """The characters that stand for the 256 bytes in a byte-level vocabulary.

    Printable Latin-1 stands for itself, the other bytes for the characters from 256 on. A
    space stays: no word holds one, it stands between words.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(0x100) if byte not in printable]
    letters = {byte: chr(0x100 + k) for k, byte in enumerate(others)} | {0x20: " "}
    return "".join(letters.get(byte, chr(byte)) for byte in range(0x100))


_BYTE_LETTERS = _byte_letters()


def _is_one_piece(word: bytes) -> bool:
    """Lower-case Latin letters only: normalising and splitting leave such a word as it is."""
    text = word.decode("utf-8")
    return (
        text.isalpha() and max(text) < "\u0250" and text == text.lower()
        and unicodedata.is_normalized("NFC", text)
    )


class _Words(dict):
    """Ids by word; words that aren't known are noted when they are asked for."""

    def __init__(self):
        self.unknown: set[bytes] = set()

    def __missing__(self, word: bytes) -> None:
        self.unknown.add(word)


class WordEncoder:
    """Ids by a tokenizer that puts A-Z in lower case and never joins across ASCII blanks.

    Words are remembered. A stop or comma behind a letter is a word of its own to such a
    tokenizer, so it is looked up by itself. Words of lower-case letters go to the tokenizer's
    merges directly.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_buffer(model)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.is_end[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known = _Words()

    @staticmethod
    def _lowered(body: bytes) -> bytes:
        """A-Z in lower case, unless that could make a special token or compose with a mark."""
        return body if b"<|" in body or b"\xcc" in body or b"\xcd" in body else body.lower()

    def _learn_letters(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        """Words of one piece each: the ids of a word end with that of a word's end."""
        for start in range(0, len(words), 4096):
            some = words[start : start + 4096]
            text = codecs.charmap_decode(b" ".join(some), "strict", _BYTE_LETTERS)[0]
            ids = np.array(
                self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"
            )
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some):
                self._cut(some, ids, [0, *(4 * ends).tolist()], into)
            else:  # the vocabulary doesn't mark ends
                self._learn(some, into)

    def _learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        for start in range(0, len(words), 4096):
            some = words[start : start + 4096]
            found = self.tokenizer.encode(
                [word.decode("utf-8") for word in some], is_pretokenized=True, add_special_tokens=False
            )
            cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some) + 1))
            self._cut(some, np.array(found.ids, "<u4"), (4 * cuts).tolist(), into)

    @staticmethod
    def _cut(words: list[bytes], ids: np.ndarray, cuts: list[int], into: dict[bytes, bytes]) -> None:
        packed = ids.tobytes()
        into.update((w, packed[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without special ones."""
        known = self.known
        if len(known) >= MEMORY_WORDS:
            known.clear()
        split = [self._lowered(body).split() for body in bodies]
        found = [list(map(known.__getitem__, words)) for words in split]
        now = self._learned() if known.unknown else {}
        out = []
        for words, ids in zip(split, found):
            try:
                out.append(b"".join(ids))
            except TypeError:  # some weren't known
                out.append(b"".join([now[w] if x is None else x for w, x in zip(words, ids)]))
        known.update(item for item in now.items() if len(item[0]) <= MEMORY_BYTES)
        return out

    def _learned(self) -> dict[bytes, bytes]:
        """Ids of the words that were asked for and aren't known yet."""
        unknown, self.known.unknown = self.known.unknown, set()
        stem_of = {
            word: word[:-1] for word in unknown
            if word.endswith((b".", b",")) and word[-2:-1].isalpha() and b"<|" not in word
        }
        needed = {*stem_of.values(), b".", b","} if stem_of else set()
        known = self.known
        new = {word for word in unknown if word not in stem_of}
        new |= {word for word in needed if word not in known}
        now: dict[bytes, bytes] = {}
        plain = [w for w in new if (w.islower() if w.isalpha() else not w.isascii() and _is_one_piece(w))]
        self._learn_letters(plain, now)
        self._learn(list(new.difference(plain)), now)
        for word, stem in stem_of.items():
            now[word] = b"".join(
                now[part] if part in now else known[part] for part in (stem, word[-1:])
            )
        return now


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> WordEncoder:
    return WordEncoder(model)


SHARDS = (
    "part INT, shard INT, before BIGINT, n_ids BIGINT, doc_ids ARRAY<BIGINT>, "
    "lengths ARRAY<BIGINT>, code BINARY"
)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Encode all texts, store their shards in ascending doc_id, return the stored table.

    The tokenizer must be a byte-level one that normalises to NFC and lower case, drops ASCII
    blanks, and splits there and between letters and stops. ``before`` counts the ids of the
    same part (a range of doc_ids) in earlier shards.
    """
    spark = docs.sparkSession
    model = small_bytes(spark, tokenizer_path)
    ordered = (
        texts(docs)
        .repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encoder = encoder_of(model.value)
        part = TaskContext.get().partitionId()
        doc_ids, held, size, shard, before = [], [], 0, 0, 0

        def closed():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                    pa.array([before], pa.int64()), pa.array([size], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([[len(ids) // 4 for ids in held]], pa.list_(pa.int64())),
                    pa.array([pack(np.frombuffer(b"".join(held), "<u4"))], pa.binary()),
                ],
                names=["part", "shard", "before", "n_ids", "doc_ids", "lengths", "code"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                bodies = utf8(piece.column(1))
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode(bodies)):
                    doc_ids.append(doc_id)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SHARD_IDS:
                        yield closed()
                        before += size
                        doc_ids, held, size, shard = [], [], 0, shard + 1
        if held:
            yield closed()

    return cut_lineage(ordered.mapInArrow(write, SHARDS))


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per document of the stored shards: start, n_tokens and ids_crc32."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part, that is per write task: at most as many as there are partitions
    before_part = sizes.select(
        "part",
        F.coalesce(
            F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("part_start"),
    )

    def read(batches):
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                ids = TokenShard(column["code"][k].as_py()).all()
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                lengths = column["lengths"][k].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [
                    zlib.crc32(data[a:b]) for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())
                ]
                first = column["part_start"][k].as_py() + column["before"][k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [column["doc_ids"][k].values, pa.array(first + starts), pa.array(lengths),
                     pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.join(F.broadcast(before_part), "part").mapInArrow(
        read, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"
    )
