"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles. Equal texts are one set. The join is exact:

1. Shingles are counted over the whole corpus. Blocks of documents send each bucket of the
   hash space one packed array; buckets send back only shingles that two sets share.
2. In the order (count, hash) a set that may reach the threshold shares one of its first
   ``n - ceil(t n) + 1`` shingles. Sets whose first shingles are all their own have no
   partner and leave here.
3. Similar sets are grouped: each is compared with the most central set of the same least
   hash, and linked sets become one component, which is cut into groups of bounded size.
4. The matrix holds which group has which of the first shingles. A set queries the groups
   of other components that share one; the group's union of shingles bounds the overlap
   with any member, and only groups that reach the bound are opened and compared.

No pair inside a component is listed, so groups of copies cost what they hold. To count the
links of each document, sets query the groups of their own component too, and all members of
an opened group are compared; a set counts as often as its text is there. Shingles that are
frequent within a block are counted there, so no bucket gets all their documents.

Defined cases: null, empty and blank texts have no shingle and are linked with nothing;
a text of fewer words than a shingle is one shingle; rows with equal doc_id are separate
documents; repeated rows give repeated results; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmason.llm.common import (
    ascii_lower, gather, join_dealt, mix64, partitions, release_shuffles, texts, tidy,
)
from textmason.llm.components import components
from textmason.session import cut_lineage, forget

WORDS, PERCENT = 5, 80
#: A block of documents is closed beyond so many shingles, or sets.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 20, 1 << 16
#: Bits of a node's number: of the set in its block, and of the block in its partition.
SET_BITS, BLOCK_BITS = 16, 24
#: From so many sets of a block on, a shingle is counted in the block.
FREQUENT = 64
#: Members of a group, on average at most; queries of a group answered in one part.
GROUP_SETS, GROUP_QUERIES = 64, 2048
#: Independent least hashes by which similar sets meet.
KEYS = 4
#: Words remembered per worker.
MEMORY_WORDS = 1 << 18
_ALL = np.uint32(0xFFFFFFFF)

# kinds of packed rows
_SETS, _TOKENS, _FREQUENT, _PLACES = range(4)
_PACKED = (
    "bucket INT, block BIGINT, kind INT, tokens BINARY, numbers BINARY, digests ARRAY<STRING>, "
    "firsts ARRAY<BIGINT>, sizes ARRAY<BIGINT>"
)
_PACKED_TYPES = (
    ("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("tokens", pa.binary()),
    ("numbers", pa.binary()), ("digests", pa.list_(pa.string())), ("firsts", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())),
)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_PACKED_TYPES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, _PACKED_TYPES)],
        names=[name for name, _ in _PACKED_TYPES],
    )


def least_shared(n, percent: int = PERCENT):
    """The least overlap with which a set of ``n`` may be linked."""
    return -(-percent * n // 100)


def digest_of(text: Column) -> Column:
    """Name of all texts that are equal in lower case."""
    return F.md5(ascii_lower(text).cast("binary"))


class Shingler:
    """Sets of shingle hashes of lower-cased texts."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}
        powers = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, words + 1)]
        self.powers = [np.uint64(p) for p in powers]

    def set_of(self, raw: bytes) -> np.ndarray:
        words = raw.split()  # bytes split at the six ASCII blanks
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            codes = [known[w] for w in words]
        except KeyError:
            if len(known) > MEMORY_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            codes = [known[w] for w in words]
        values = mix64(np.array(codes, np.uint64))
        size = min(self.words, len(values))
        total = np.full(len(values) - size + 1, size, np.uint64)
        for k in range(size):
            total += values[k : len(values) - size + 1 + k] * self.powers[k]
        return np.unique(mix64(total))


def _packed_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as bytes that compress: the planes of their differences."""
    steps = np.diff(values, prepend=np.zeros(1, np.uint64)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of equal values in a sorted array."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    return starts, np.diff(np.concatenate((starts, [len(ordered)])))


def _numbered(part: int, block: int) -> int:
    """Number of a block among all; raises where numbers would run into the next partition's."""
    if block >> BLOCK_BITS or part >> (63 - SET_BITS - BLOCK_BITS):
        raise OverflowError(f"block {block} of partition {part} has no number")
    return part << BLOCK_BITS | block


def _block_rows(block: int, sets: list, buckets: int) -> list[tuple]:
    """Packed rows of one block: its sets, its shingles by bucket, its frequent ones."""
    digests, firsts, tokens = zip(*sets)
    sizes = np.array([len(t) for t in tokens], np.int64)
    values = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(sets)).astype(np.uint16), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts, lengths = _runs(values)
    frequent = lengths >= FREQUENT
    often = np.repeat(frequent, lengths)
    home = int(mix64(np.array([block]))[0] % np.uint64(buckets))
    rows = [(home, block, _SETS, None, None, list(digests), list(firsts), sizes.tolist())]
    if often.any():
        rows.append((home, block, _PLACES, values[often].tobytes(), owner[often].tobytes(),
                     None, None, None))
    for kind, some, numbers in (
        (_TOKENS, values[~often], owner[~often]),
        (_FREQUENT, values[starts[frequent]], lengths[frequent].astype(np.uint32)),
    ):
        place = ((some >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.searchsorted(place, np.arange(buckets + 1))
        rows += [
            (k, block, kind, _packed_sorted(some[a:b]), numbers[a:b].tobytes(), None, None, None)
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b
        ]
    return rows


def _shared(tokens: list, numbers: list, blocks: list, kinds: list):
    """Packed rows that tell each block which of its shingles two sets hold, and how many do."""
    values = np.concatenate(tokens)
    number = np.concatenate(numbers)
    source = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    order = np.argsort(values, kind="stable")
    values, number, source = values[order], number[order], source[order]
    counted = np.array(kinds)[source] == _FREQUENT
    weight = np.where(counted, number, 1).astype(np.int64)
    starts, lengths = _runs(values)
    df = np.repeat(np.add.reduceat(weight, starts), lengths) if len(values) else weight
    keep = df >= 2
    values, source, df = values[keep], source[keep], df[keep]
    number = np.where(counted[keep], _ALL, number[keep]).astype(np.uint32)
    block = np.array(blocks, np.int64)[source]
    order = np.argsort(block, kind="stable")
    block, values, number, df = block[order], values[order], number[order], df[order]
    starts, lengths = _runs(block)
    for a, n in zip(starts, lengths):
        both = np.empty((n, 2), np.uint32)
        both[:, 0], both[:, 1] = number[a : a + n], np.minimum(df[a : a + n], int(_ALL))
        yield (0, int(block[a]), _TOKENS, _packed_sorted(values[a : a + n]), both.tobytes(), None, None, None)


def _ordered_sets(block: int, rows: list[tuple], percent: int):
    """(node, digest, first, n, shared shingles in global order, how many come first)."""
    sets = places = None
    values, owners, dfs = [], [], []
    for kind, tokens, numbers, digests, firsts, sizes in rows:
        if kind == _SETS:
            sets = (digests, firsts, sizes)
        elif kind == _PLACES:
            owner = np.frombuffer(numbers, np.uint16).astype(np.uint32)
            places = (np.frombuffer(tokens, np.uint64), owner)
        else:
            both = np.frombuffer(numbers, np.uint32).reshape(-1, 2)
            values.append(_unpacked_sorted(tokens))
            owners.append(both[:, 0])
            dfs.append(both[:, 1])
    digests, firsts, sizes = sets
    value = np.concatenate(values) if values else np.zeros(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.uint32)
    df = np.concatenate(dfs) if dfs else np.zeros(0, np.uint32)
    counted = owner == _ALL
    if counted.any():
        # frequent shingles came back once; their sets are known here
        order = np.argsort(value[counted])
        known, known_df = value[counted][order], df[counted][order]
        at = np.searchsorted(known, places[0])
        value = np.concatenate((value[~counted], places[0]))
        owner = np.concatenate((owner[~counted], places[1]))
        df = np.concatenate((df[~counted], known_df[at]))
    order = np.lexsort((value, df, owner))
    value, owner = value[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
    for k, (digest, first, n) in enumerate(zip(digests, firsts, sizes)):
        shared = value[edges[k] : edges[k + 1]]
        own = n - len(shared)
        front = n - least_shared(n, percent) + 1 - own if n else 0
        alone = front <= 0
        yield (block << SET_BITS | k, digest, first, n, None if alone else shared.tobytes(),
               0 if alone else front)


_SETS_SCHEMA = "node BIGINT, digest STRING, first BIGINT, n BIGINT, tokens BINARY, front INT"
_SETS_TYPES = (("node", pa.int64()), ("digest", pa.string()), ("first", pa.int64()),
               ("n", pa.int64()), ("tokens", pa.binary()), ("front", pa.int32()))


def token_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One stored row per distinct lower-cased text; ``tokens`` only where a partner is possible."""
    spark = docs.sparkSession
    count = partitions(spark)
    buckets = 4 * count
    distinct = (
        texts(docs).select("doc_id", ascii_lower(F.col("text")).alias("text"))
        .groupBy("text").agg(F.min("doc_id").alias("first"))
        .select(digest_of(F.col("text")).alias("digest"), "first", "text")
        .sortWithinPartitions("digest")  # a repeated task must build the same blocks
    )

    def shingle(batches):
        shingler, held, size, blocks = Shingler(words), [], 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for digest, first, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    held.append((digest, first, shingler.set_of(text.encode("utf-8"))))
                    size += len(held[-1][2])
                    if size >= BLOCK_SHINGLES or len(held) == BLOCK_SETS:
                        yield _packed(_block_rows(_numbered(part, blocks), held, buckets))
                        held, size, blocks = [], 0, blocks + 1
        if held:
            yield _packed(_block_rows(_numbered(part, blocks), held, buckets))

    def count_shared(batches):
        tokens, numbers, blocks, kinds = [], [], [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2] in (_SETS, _PLACES):
                    yield _packed([row])
                else:
                    tokens.append(_unpacked_sorted(row[3]))
                    kind = np.uint32 if row[2] == _FREQUENT else np.uint16
                    numbers.append(np.frombuffer(row[4], kind).astype(np.uint32))
                    blocks.append(row[1])
                    kinds.append(row[2])
        if tokens:
            for row in _shared(tokens, numbers, blocks, kinds):
                yield _packed([row])

    def order(batches):
        def finished(block, rows):
            columns = zip(*_ordered_sets(block, rows, percent))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(columns, _SETS_TYPES)],
                names=[name for name, _ in _SETS_TYPES],
            )

        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] != now and rows:
                    yield finished(now, rows)
                    rows = []
                now = row[1]
                rows.append(row[2:])
        if rows:
            yield finished(now, rows)

    return cut_lineage(
        distinct.mapInArrow(tidy(shingle), _PACKED)
        .repartition(count, "bucket").mapInArrow(tidy(count_shared), _PACKED)
        .repartition(count, "block").sortWithinPartitions("block").mapInArrow(tidy(order), _SETS_SCHEMA)
    )


def _tokens(data: bytes) -> np.ndarray:
    return np.sort(np.frombuffer(data, np.uint64))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray, percent: int) -> bool:
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    shared = _overlap(a, b)
    return 100 * shared >= percent * (n_a + n_b - shared)


def _keys(batches):
    """(seed, key, node, own): least hashes of each set under independent orders."""
    for batch in batches:
        nodes, shares, tokens = batch.columns
        values = [np.frombuffer(t, np.uint64) for t in tokens.to_pylist()]
        for seed in range(KEYS):
            salt = np.uint64(0xA0761D6478BD642F * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
            keys = [int(mix64(v ^ salt).min().astype(np.int64)) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array([seed] * len(keys), pa.int32()), pa.array(keys, pa.int64()), nodes, shares],
                names=["seed", "key", "node", "own"],
            )


def star_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """True links (u, v) of each set with the most central set of the same least hash.

    The set with the least share of shingles of its own is the one that edited copies were
    made from, if that is there: copies are more like it than like each other.
    """
    own = (F.col("n") - F.octet_length("tokens") / 8) / F.col("n")
    keyed = sets.select("node", own.alias("own"), "tokens").mapInArrow(
        tidy(_keys), "seed INT, key BIGINT, node BIGINT, own DOUBLE"
    )
    central = F.min(F.struct("own", "node"))
    pivots = (
        keyed.groupBy("seed", "key").agg(central.alias("central"), F.count("*").alias("sets"))
        .filter("sets > 1").select("seed", "key", F.col("central.node").alias("pivot"))
    )
    pairs = (
        keyed.join(pivots, ["seed", "key"]).filter("node <> pivot").select("node", "pivot").distinct()
    )
    other = sets.select(
        F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("tokens").alias("pivot_tokens")
    )

    def compare(batches):
        for batch in batches:
            found = [[], []]
            for node, n, tokens, pivot, pivot_n, pivot_tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if _linked(n, _tokens(tokens), pivot_n, _tokens(pivot_tokens), percent):
                    found[0].append(node)
                    found[1].append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["u", "v"])

    return (
        pairs.join(sets.select("node", "n", "tokens"), "node").join(other, "pivot")
        .select("node", "n", "tokens", "pivot", "pivot_n", "pivot_tokens")
        .mapInArrow(tidy(compare), "u BIGINT, v BIGINT")
    )


def group_links(sets: DataFrame, percent: int = PERCENT, every: bool = False) -> DataFrame:
    """Links between sets of different components, found through the token-group matrix.

    ``sets`` has node, n, tokens, front, component and grp. The links are stored. With
    ``every`` it also has copies, all pairs of sets are found from both sides, and a row
    (u, v, n) stands for the links of ``u`` into one group: ``v`` is one of the linked sets,
    and ``n`` is the sum of their copies.
    """

    def front(batches):
        for batch in batches:
            nodes, sizes, tokens, fronts, parts, groups = (c.to_pylist() for c in batch.columns)
            firsts = [np.frombuffer(t, np.int64)[:f] for t, f in zip(tokens, fronts)]
            lengths = [len(f) for f in firsts]
            # at most so many shingles are common if this is the first common one
            left = [len(t) // 8 - np.arange(f) for t, f in zip(tokens, lengths)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in (firsts, left)]
                + [pa.array(np.repeat(np.array(c, np.int64), lengths), pa.int64())
                   for c in (nodes, sizes, parts, groups)],
                names=["token", "left", "node", "n", "component", "grp"],
            )

    entries = sets.select("node", "n", "tokens", "front", "component", "grp").mapInArrow(
        tidy(front), "token BIGINT, left BIGINT, node BIGINT, n BIGINT, component BIGINT, grp BIGINT"
    )
    # Shingles that stay within one component link nothing new. Those that the same sets
    # have, such as all of a passage, are one class: they would give the same pairs.
    classes = (
        entries.groupBy("token").agg(
            F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("sets"),
            *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"who{k}") for k in (1, 2)),
        )
        .filter("sets > 1" if every else "a <> b")
        .select("token", F.sha1(F.concat_ws("-", "sets", "who1", "who2")).alias("class"))
    )
    entries = cut_lineage(
        entries.join(classes, "token").groupBy("class", "node", "n", "component", "grp")
        .agg(F.max("left").alias("left"))
    )
    matrix = entries.groupBy("class", "grp").agg(
        F.min("component").alias("other"), F.min("n").alias("least_n"), F.max("n").alias("most_n"),
        F.max("left").alias("most_left"),
    )
    pairs = cut_lineage(
        entries.select("class", "node", "n", "component", "left").join(matrix, "class")
        .filter((F.lit(True) if every else F.col("component") < F.col("other"))
                & (100 * F.col("n") >= percent * F.col("least_n"))
                & (100 * F.col("most_n") >= percent * F.col("n"))
                & ((100 + percent) * F.least("left", "most_left")
                   >= percent * (F.col("n") + F.col("least_n"))))
        .select("node", "grp").distinct()
    )
    parts = pairs.groupBy("grp").agg(
        F.ceil(F.count("*") / F.lit(GROUP_QUERIES)).cast("int").alias("parts")
    )
    copies = ["copies"] if every else []
    members = sets.select("grp", "node", "n", "tokens", *copies).join(parts, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("role"), "node", "n", "tokens", *copies,
    )
    asking = (
        pairs.join(parts, "grp")
        .select("grp", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
                F.lit(1).alias("role"), "node")
        .join(sets.select("node", "n", "tokens", *copies), "node")
        .select("grp", "part", "role", "node", "n", "tokens", *copies)
    )

    def count(batches):
        now, group, held = None, [], None
        for batch in batches:
            found = [[], [], []]
            for grp, part, role, node, n, data, weight in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, part) != now:
                    now, group, held = (grp, part), [], None
                tokens = _tokens(data)
                if role == 0:
                    group.append((node, n, tokens, weight))
                    continue
                if held is None:
                    values = np.concatenate([t for _, _, t, _ in group])
                    owner = np.repeat(np.arange(len(group)), [len(t) for _, _, t, _ in group])
                    order = np.argsort(values, kind="stable")
                    held = (values[order], owner[order],
                            *(np.array([m[k] for m in group], np.int64) for k in (0, 1, 3)))
                values, owner, nodes, sizes, weights = held
                first = np.searchsorted(values, tokens, "left")
                last = np.searchsorted(values, tokens, "right")
                shared = np.bincount(owner[gather(first, last - first)], minlength=len(nodes))
                linked = (100 * shared >= percent * (n + sizes - shared)) & (nodes != node)
                if linked.any():
                    found[0].append(node)
                    found[1].append(int(nodes[linked][0]))
                    found[2].append(int(weights[linked].sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in found], names=["u", "v", "n"]
            )

    def answer(batches):
        now, group, union = None, [], None
        for batch in batches:
            found = [[], []]
            for grp, part, role, node, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, part) != now:
                    now, group, union = (grp, part), [], None
                tokens = _tokens(data)
                if role == 0:
                    group.append((node, n, tokens))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([t for _, _, t in group]))
                if _overlap(tokens, union) < least_shared(n, percent):
                    continue  # no member can reach the threshold
                for other, other_n, other_tokens in group:
                    if _linked(n, tokens, other_n, other_tokens, percent):
                        found[0].append(node)
                        found[1].append(other)
                        break  # the group is one component, so one link joins them
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["u", "v"])

    links = cut_lineage(
        members.unionAll(asking)
        .repartition(partitions(sets.sparkSession), "grp", "part")
        .sortWithinPartitions("grp", "part", "role")
        .mapInArrow(tidy(count if every else answer), "u BIGINT, v BIGINT" + ", n BIGINT" * every)
    )
    forget(entries, pairs)
    return links


def jaccard_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, counted: bool = False
) -> DataFrame:
    """Per document: n_shingles and component_id, the least doc_id reachable by links.

    With ``counted`` also n_links, how many other documents it is linked with.

    ``digest`` is that of the lower-cased text, for callers that need the row again. The
    result reads two stored tables; the others are deleted here.
    """
    everything = token_sets(docs, words, percent)
    release_shuffles(docs.sparkSession)
    sets = everything.filter("tokens IS NOT NULL")
    rows = texts(docs).select("doc_id", digest_of(F.col("text")).alias("digest"))
    if counted:
        weights = cut_lineage(
            rows.groupBy("digest").agg(F.count("*").alias("copies"))
            .join(everything.select("digest", "node"), "digest").select("node", "copies")
        )
        sets = sets.join(weights, "node")
    stars = cut_lineage(star_links(sets, percent))
    first = components(stars)
    sizes = first.groupBy("component").agg(
        F.ceil(F.count("*") / F.lit(GROUP_SETS)).alias("groups")
    )
    placed = first.join(sizes, "component")
    grouped = cut_lineage(
        sets.join(placed, "node", "left").select(
            "node", "n", "tokens", "front", *(["copies"] if counted else []),
            F.coalesce("component", "node").alias("component"),
            F.xxhash64(
                F.coalesce("component", "node"),
                F.pmod(F.xxhash64("node"), F.coalesce("groups", F.lit(1))),
            ).alias("grp"),
        )
    )
    more = group_links(grouped, percent, every=counted)
    linked = components(stars.unionAll(more.select("u", "v")))
    if counted:
        others = more.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
        n_links = cut_lineage(weights.join(others, "node", "left").select(
            "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        ))
        forget(weights)
    forget(stars, first, grouped, more)
    release_shuffles(docs.sparkSession)
    labels = (
        everything.select("node", "first").join(linked, "node")
        .groupBy("component").agg(F.min("first").alias("component_id"))
    )
    by_node = linked.join(labels, "component").select("node", "component_id")
    by_text = everything.select("node", "digest", "n", "first").join(by_node, "node", "left")
    if counted:
        by_text = by_text.join(n_links, "node")
    by_text = by_text.select(
        "digest", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "first").alias("component_id"),
        *([F.when(F.col("n") == 0, 0).otherwise(F.col("n_links")).alias("n_links")] if counted else []),
    )
    # every digest is there; a text with many copies is dealt to many tasks
    return join_dealt(rows, by_text, ["digest"], F.col("doc_id")).select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"),
        *(["n_links"] if counted else []),
        "digest",
    )
