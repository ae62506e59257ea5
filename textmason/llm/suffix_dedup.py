"""Removal of repeated strings by a distributed, bounded suffix sort over a difference cover.

Every byte inside a string of ``LENGTH`` bytes that also starts earlier is removed. A
difference cover makes any two equal strings hold sampled positions at the same offset; here
it is content-defined: each string samples the least 32-gram it holds, so equal strings
always sample the same place, and only 3 in 100 positions are sampled.

1. Sampled 32-grams are counted; those seen once belong to no repeated string.
2. A repeated sample is sent with the bytes around it. In each bucket the suffixes at the
   samples are sorted: triples of 8-byte words are sorted and named, triples of names
   again, until one name is left; the bytes before the samples are sorted likewise.
3. The remaining suffixes, those that start between samples, are merged by the name of the
   bytes before the next sample and the name of the suffix there.
4. Adjacent prefixes are compared byte by byte, which gives the names at every length; of
   the starts with equal names all but the earliest are marked. No hash decides equality.

Documents are dealt to blocks once and that shuffle is read again by each step. Equal
strings of a block are sent once, and frequent samples by their whole string, so a passage
that many documents share doesn't meet in one task.

Defined cases: a null or empty text has no bytes and nothing to remove, and so has a text
shorter than ``LENGTH``; documents are ordered by doc_id (null first), rows with equal
doc_id are separate documents in an arbitrary fixed order, and of fully repeated rows one
is kept; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmason.llm.common import gather, mix64, partitions, texts, tidy, tidy_group, utf8

LENGTH = 100
GRAM = 32
#: Positions sampled at once, which bounds the memory of a very long text.
STEP = 1 << 20
#: Bytes of text in a block of documents, on average, and for each bucket of samples; their
#: number follows the input, so that a block has some samples for each bucket.
BLOCK_BYTES, LEAST_BLOCKS = 4 << 20, 8
#: A sample seen so often is sent by its whole strings.
FREQUENT = 4096
_LOW = np.uint64(0xFFFFFFFF)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_HASHES, _ENTRIES, _SPANS = range(3)
_PACKED = "bucket INT, block INT, kind INT, numbers BINARY, bytes BINARY"
_PACKED_TYPES = (("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()),
                 ("numbers", pa.binary()), ("bytes", pa.binary()))
#: A sampled place: its 32-gram, document and position, and the starts it stands for.
_PLACE = np.dtype([("gram", "<u8"), ("doc_id", "<i8"), ("doc", "<u4"), ("at", "<u4"),
                   ("least", "u1"), ("most", "u1")])
_SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4")])


def _table(rows: list[tuple], types=_PACKED_TYPES) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, types)})


def _batches(rows: list[tuple]):
    return _table(rows).to_batches()


def _documents(block: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers in the order of the block, doc_ids, bytes of all texts, and their edges."""
    ids = block.column("doc_id").to_pylist()
    bodies = utf8(block.column("text").combine_chunks())
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, bodies[k]))
    edges = np.concatenate(([0], np.cumsum([len(bodies[k]) for k in order]))).astype(np.int64)
    data = np.frombuffer(b"".join([bodies[k] for k in order]), np.uint8)
    least = np.iinfo(np.int64).min
    return order, np.array([least if ids[k] is None else ids[k] for k in order], np.int64), data, edges


def _samples(data: np.ndarray, edges: np.ndarray, length: int):
    """(gram, at, first start, last start) of the samples, in order.

    A start's sample is the least 32-gram among those inside its string; ties go left.
    """
    window = length - GRAM + 1
    for begin in range(0, len(data), STEP):
        stop = min(len(data), begin + STEP)
        values = _TABLE[data[begin : stop + length - 1]]
        if len(values) < length:
            return
        base, size = 0x9E3779B97F4A7C15, 1
        while size < GRAM:
            values = values[:-size] * np.uint64(pow(base, size, 1 << 64)) + values[size:]
            size *= 2
        grams = mix64(values)
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: -(window - size)], least[window - size :])
        first = int(np.searchsorted(edges, begin, "right")) - 1
        last = int(np.searchsorted(edges, stop, "left"))
        inside = np.clip(edges[first : last + 1], begin, stop)
        ends = np.repeat(edges[first + 1 : last + 1], np.diff(inside))
        starts = np.arange(begin, begin + min(len(least), len(ends)))
        starts = starts[starts + length <= ends[: len(starts)]]
        if not len(starts):
            continue
        at = (least[starts - begin] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        final = np.concatenate((new[1:], [len(starts)])) - 1
        # least hashes are small ones: spread them again, for even buckets
        yield mix64(grams[at[new]]), at[new] + begin, starts[new], starts[final]


def _sampled(data, edges, length):
    found = list(zip(*_samples(data, edges, length)))
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(part) for part in found)


def _by_bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _count_samples(buckets: int, length: int):
    def count(key, block):
        _, _, data, edges = _documents(block)
        grams, times = np.unique(_sampled(data, edges, length)[0], return_counts=True)
        cuts = np.searchsorted(_by_bucket(grams, buckets), np.arange(buckets + 1))
        number = key[0].as_py()
        return _table([
            (k, number, _HASHES, grams[a:b].tobytes(), times[a:b].astype("<u4").tobytes())
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b
        ])

    return count


def _repeated_samples(batches):
    """Tell each block which of its samples occur twice, and which are frequent."""
    grams, times, blocks = [], [], []
    for batch in batches:
        for _, block, _, some, counts in zip(*(c.to_pylist() for c in batch.columns)):
            grams.append(np.frombuffer(some, "<u8"))
            times.append(np.frombuffer(counts, "<u4"))
            blocks.append(np.full(len(grams[-1]), block, np.int32))
    if not grams:
        return
    values, counts, block = np.concatenate(grams), np.concatenate(times), np.concatenate(blocks)
    order = np.argsort(values, kind="stable")
    values, counts, block = values[order], counts[order], block[order]
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    totals = np.repeat(np.add.reduceat(counts.astype(np.int64), starts),
                       np.diff(np.concatenate((starts, [len(values)]))))
    keep = totals >= 2
    values, block, often = values[keep], block[keep], totals[keep] >= FREQUENT
    order = np.argsort(block, kind="stable")
    values, block, often = values[order], block[order], often[order]
    cuts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
    if len(block):
        yield from _batches([
            (0, int(block[a]), _HASHES, values[a:b].tobytes(), often[a:b].tobytes())
            for a, b in zip(cuts[:-1], cuts[1:])
        ])


def _send_places(buckets: int, length: int):
    def send(key, block, hashes):
        number = key[0].as_py()
        if not hashes.num_rows or not block.num_rows:
            return _table([])
        known = np.concatenate([np.frombuffer(x, "<u8") for x in hashes.column("numbers").to_pylist()])
        often = np.concatenate([np.frombuffer(x, bool) for x in hashes.column("bytes").to_pylist()])
        order = np.argsort(known)
        known, often = known[order], often[order]
        _, ids, data, edges = _documents(block)
        grams, at, first, last = _sampled(data, edges, length)
        where = np.searchsorted(known, grams)
        where[where == len(known)] = 0
        keep = known[where] == grams
        grams, at, first, last, often = grams[keep], at[keep], first[keep], last[keep], often[where[keep]]
        # frequent samples by their single starts
        each = np.where(often, last - first + 1, 1)
        source = np.repeat(np.arange(len(grams)), each)
        starts = gather(first, each)
        stops = np.where(often[source], starts, last[source])
        doc = np.searchsorted(edges, starts, "right") - 1
        whole = data.tobytes()
        bodies = [whole[a : b + length] for a, b in zip(starts.tolist(), stops.tolist())]
        places = np.zeros(len(starts), _PLACE)
        places["gram"], places["doc_id"], places["doc"] = grams[source], ids[doc], doc
        places["at"] = at[source] - edges[doc]
        places["least"], places["most"] = at[source] - stops, at[source] - starts
        # equal places of the block are sent once: the earliest; the others are marked here
        seen, sent, marked = {}, [], []
        spread = (places["least"].tolist(), places["most"].tolist(), places["gram"].tolist())
        for k, unit in enumerate(zip(*spread, bodies)):
            if unit in seen:
                marked.append(k)
            else:
                seen[unit] = k
                sent.append(k)
        del seen
        rows = []
        if marked:
            spans = np.zeros(len(marked), _SPAN)
            spans["doc"] = doc[marked]
            spans["start"] = starts[marked] - edges[doc[marked]]
            spans["end"] = stops[marked] + length - edges[doc[marked]]
            rows.append((number % buckets, number, _SPANS, _united(spans).tobytes(), None))
        chosen = np.array(sent, np.int64)
        target = _by_bucket(grams, buckets)[source[chosen]].astype(np.int64) if sent else chosen
        by_string = often[source[chosen]] if sent else np.zeros(0, bool)
        for k in np.flatnonzero(by_string).tolist():
            digest = hashlib.blake2b(bodies[sent[k]], digest_size=8).digest()
            target[k] = int.from_bytes(digest, "little") % buckets
        order = np.argsort(target, kind="stable")
        cuts = np.searchsorted(target[order], np.arange(buckets + 1))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                some = chosen[order[a:b]]
                rows.append((k, number, _ENTRIES, places[some].tobytes(),
                             b"".join([bodies[j] for j in some.tolist()])))
        return _table(rows)

    return send


def _united(spans: np.ndarray) -> np.ndarray:
    """The same bytes in as few spans as possible, in order."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    # ends so far within a document: documents are laid out behind each other
    far = spans["doc"].astype(np.int64) << 33
    starts, ends = far + spans["start"], np.maximum.accumulate(far + spans["end"])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(spans)])) - 1
    out = spans[first].copy()
    out["end"] = ends[last] - far[last]
    return out


def _names(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows: triples of columns are sorted and named, then triples of names."""
    while True:
        named = []
        for k in range(0, len(columns), 3):
            triple = columns[k : k + 3]
            order = np.lexsort(triple[::-1])
            new = np.zeros(len(order), bool)
            for column in triple:
                new[1:] |= column[order][1:] != column[order][:-1]
            names = np.empty(len(order), np.int64)
            names[order] = np.cumsum(new)
            named.append(names)
        columns = named
        if len(columns) == 1:
            return columns[0]


def _sorted_with_prefixes(gram: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) of byte rows, those of a gram together."""
    words = rows.view(">u8").astype(np.uint64)
    names = _names([gram] + [words[:, k] for k in range(words.shape[1])])
    order = np.argsort(names, kind="stable")
    ranked, of = rows[order], gram[order]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = ranked[1:] != ranked[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        common[1:][of[1:] != of[:-1]] = -1
    if len(order):
        common[0] = -1
    return order, common


def _padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, step: int) -> np.ndarray:
    """Byte rows of equal width; ``step`` -1 reads backwards from ``starts``."""
    rows = np.zeros((len(starts), width), np.uint8)
    for k in range(width):
        some = np.flatnonzero(lengths > k)
        rows[some, k] = data[starts[some] + step * k]
    return rows


def _later_starts(places: np.ndarray, block: np.ndarray, data: np.ndarray, length: int):
    """(place, distance to its sample) of all starts whose string also starts earlier."""
    before, after = places["most"].astype(np.int64), length - places["least"].astype(np.int64)
    ends = np.cumsum(before + after)
    sample = ends - after
    rank = np.lexsort((places["at"], places["doc"], block, places["doc_id"]))
    places, before, after, sample = places[rank], before[rank], after[rank], sample[rank]
    gram = places["gram"]
    if not len(gram):
        return rank, []
    right = _sorted_with_prefixes(gram, _padded(data, sample, after, -(-length // 8) * 8, 1))
    width = -(-max(int(before.max()), 1) // 8) * 8
    left = _sorted_with_prefixes(gram, _padded(data, sample - 1, before, width, -1))
    found = []
    for distance in range(int(places["least"].min()), int(places["most"].max()) + 1):
        some = np.flatnonzero((places["least"] <= distance) & (distance <= places["most"]))
        if len(some) < 2:
            continue
        name = np.empty(len(gram), np.int64)
        name[right[0]] = np.cumsum(right[1] < length - distance)
        ahead = np.empty(len(gram), np.int64)
        ahead[left[0]] = np.cumsum(left[1] < distance)
        key = name[some] * (len(gram) + 1) + ahead[some]
        order = np.argsort(key, kind="stable")  # places are in document order
        ranked = key[order]
        later = some[order[1:][ranked[1:] == ranked[:-1]]]
        found.append((later, distance))
    return rank, found


def _mark_later(length: int):
    def finish(places: list, bodies: list, blocks: list):
        place = np.concatenate([np.frombuffer(x, _PLACE) for x in places])
        block = np.repeat(np.array(blocks, np.int64), [len(x) // _PLACE.itemsize for x in places])
        rank, found = _later_starts(place, block, np.frombuffer(b"".join(bodies), np.uint8), length)
        if not found:
            return
        which = rank[np.concatenate([later for later, _ in found])]
        distance = np.concatenate([np.full(len(later), d) for later, d in found])
        spans = np.zeros(len(which), _SPAN)
        spans["doc"] = place["doc"][which]
        spans["start"] = place["at"][which] - distance
        spans["end"] = spans["start"] + length
        owner = block[which]
        order = np.argsort(owner, kind="stable")
        owner, spans = owner[order], spans[order]
        cuts = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]))
        if len(owner):
            yield from _batches([
                (0, int(owner[a]), _SPANS, _united(spans[a:b]).tobytes(), None)
                for a, b in zip(cuts[:-1], cuts[1:])
            ])

    def mark(batches):
        now, places, bodies, blocks = None, [], [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                bucket, block, kind, numbers, data = row
                if kind == _SPANS:
                    yield from _batches([row])
                    continue
                if bucket != now and places:
                    yield from finish(places, bodies, blocks)
                    places, bodies, blocks = [], [], []
                now = bucket
                places.append(numbers)
                bodies.append(data)
                blocks.append(block)
        if places:
            yield from finish(places, bodies, blocks)

    return mark


def _remove(with_rest: bool):
    def remove(key, block, marks):
        order, _, data, edges = _documents(block)
        some = [np.frombuffer(x, _SPAN) for x in marks.column("numbers").to_pylist()]
        spans = _united(np.concatenate(some)) if some else np.zeros(0, _SPAN)
        cuts = np.searchsorted(spans["doc"], np.arange(len(order) + 1))
        whole = data.tobytes()
        out = [[], [], [], [], []]
        for k in range(len(order)):
            begin, end = int(edges[k]), int(edges[k + 1])
            kept, at, removed = [], begin, 0
            for start, stop in zip(spans["start"][cuts[k] : cuts[k + 1]].tolist(),
                                   spans["end"][cuts[k] : cuts[k + 1]].tolist()):
                kept.append(whole[at : begin + start])
                at, removed = begin + stop, removed + stop - start
            kept.append(whole[at:end])
            rest = b"".join(kept)
            for column, value in zip(out, (
                end - begin, removed, int(cuts[k + 1] - cuts[k]), hashlib.sha256(rest).hexdigest(),
                rest.decode("utf-8", "ignore"),
            )):
                column.append(value)
        taken = block.take(pa.array(order, pa.int64()))
        found = {
            "doc_id": taken.column("doc_id"),
            "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()),
            "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string()),
        }
        if with_rest:
            found["kept"] = pa.array(out[4], pa.string())
            found["rest"] = taken.column("rest")
        return pa.table(found)

    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: bool = False) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256.

    With ``carry`` also ``kept`` (the remaining bytes as text, without characters that lost
    some of their bytes) and ``rest`` (the input row but for its text, as a struct).
    """
    if length < GRAM + 1 or length > 255:
        raise ValueError(f"length must be from {GRAM + 1} to 255")
    spark = docs.sparkSession
    count = partitions(spark)
    rows = texts(docs, carry=carry)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    if carry:
        rows = rows.withColumn("rest", F.col("rest").dropFields("text"))
    dealt = (
        rows
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
        .repartition(count, "block")
    )
    hashes = (
        dealt.groupBy("block").applyInArrow(tidy_group(_count_samples(buckets, length)), _PACKED)
        .repartition(count, "bucket").mapInArrow(tidy(_repeated_samples), _PACKED)
    )
    places = (
        dealt.groupBy("block").cogroup(hashes.groupBy("block"))
        .applyInArrow(tidy_group(_send_places(buckets, length)), _PACKED)
    )
    marks = (
        places.repartition(count, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(tidy(_mark_later(length)), _PACKED)
    )
    schema = "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING"
    if carry:
        schema += f", kept STRING, rest {dealt.schema['rest'].dataType.simpleString()}"
    return dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        tidy_group(_remove(bool(carry))), schema
    )
