"""Operators that compare documents with each other or with a benchmark."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from textmason.llm import components, decontaminate, jaccard_join, suffix_dedup

DOCS = "doc_id BIGINT, text STRING, lang STRING, rest STRING, block INT, digest STRING, tokens INT"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(k, t, None, "r", 1, "d", 2) for k, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=900):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def family(rng):
    """Texts with exact and near copies, shared passages and odd cases."""
    passage = " ".join(words(rng, 60))
    base = words(rng, 150)
    out = [None, "", " \n", "short", "a b", "A B", passage, "é" * 80 + passage + "é" * 80, "ab" * 700]
    for _ in range(12):
        out.append(" ".join(words(rng, rng.randint(5, 120))))
    for _ in range(75):  # enough that shingles are frequent in a block
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(["Q", "R", "S"])
        out.append(" ".join(copy))
    for _ in range(10):
        out.append(" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 30)))
    for cut in range(60, 150, 10):
        out.append(" ".join(base[:cut]))
    out += [out[20], out[20].upper(), out[20].replace(" ", "  ")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup(spark, seed):
    texts = family(random.Random(seed))
    docs = frame(spark, texts)
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, carry=True).collect()}
    for k, want in enumerate(brute.removed(texts)):
        row = found[k]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == want[:4]
        assert row.kept == want[4].decode("utf-8", "ignore")
        assert row.rest.lang is None and row.rest.digest == "d"


def test_suffix_dedup_of_periodic_and_frequent_strings(spark):
    rng = random.Random(4)
    shared = "x" * 30 + "".join(rng.choice("abc") for _ in range(150))
    texts = ["ab" * 6000, "z" * 9000, "ab" * 60]
    texts += ["".join(rng.choice("def") for _ in range(20)) + shared + str(k) for k in range(40)]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    for k, want in enumerate(brute.removed(texts)):
        assert (found[k].n_bytes, found[k].n_removed, found[k].n_spans, found[k].kept_sha256) == want[:4]


def test_suffix_dedup_odd_rows(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcd") for _ in range(300))
    docs = frame(spark, [text, text, text, text, None], [7, 7, None, 3, 3])
    found = suffix_dedup.remove_repeats(docs).collect()
    assert sum(r.n_removed == 0 and r.n_bytes == 300 for r in found) == 1
    assert [r.doc_id for r in found if r.n_bytes and not r.n_removed] == [None]
    assert len(found) == 5
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, length=20)


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard(spark, seed):
    texts = family(random.Random(seed + 10))
    found = jaccard_join.jaccard_components(frame(spark, texts)).drop("digest")
    assert sorted(map(tuple, found.collect())) == brute.jaccard_groups(list(enumerate(texts)))


def test_jaccard_links_across_components(spark):
    """Chains of texts that are linked with their neighbours only."""
    rng = random.Random(8)
    base = words(rng, 400, 10_000)
    texts = [" ".join(base[k : k + 100]) for k in range(0, 200, 5)]
    found = jaccard_join.jaccard_components(frame(spark, texts)).drop("digest")
    assert sorted(map(tuple, found.collect())) == brute.jaccard_groups(list(enumerate(texts)))


def test_jaccard_odd_rows(spark):
    text = " ".join(words(random.Random(1), 50))
    rows = [(5, text), (5, text), (5, "other words of a text"), (None, text), (None, None), (2, ""), (2, " ")]
    docs = frame(spark, [t for _, t in rows], [k for k, _ in rows])
    found = jaccard_join.jaccard_components(docs).drop("digest").collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute.jaccard_groups(rows), key=str)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def links_by_brute_force(texts):
    sets = [brute.shingles(t) for t in texts]
    return [
        sum(k != j and len(a & b) > 0 and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets))
        for k, a in enumerate(sets)
    ]


@pytest.mark.parametrize("groups", [64, 5])
def test_jaccard_links_are_counted(spark, monkeypatch, groups):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", groups)
    rng = random.Random(21)
    texts = family(rng) + [" ".join(words(rng, 30))] * 3 + ["", None]
    base = words(rng, 400, 10_000)
    texts += [" ".join(base[k : k + 100]) for k in range(0, 100, 5)]
    found = jaccard_join.jaccard_components(frame(spark, texts), counted=True).drop("digest")
    groups_of = brute.jaccard_groups(list(enumerate(texts)))
    want = [(*row, links) for row, links in zip(groups_of, links_by_brute_force(texts))]
    assert max(w[3] for w in want) > 64
    assert sorted(map(tuple, found.collect())) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    edges += [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(9, 9)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(edges, "u BIGINT, v BIGINT"))
    assert {r.node: r.component for r in found.collect()} == {k: root(k) for k in parent}
    empty = spark.createDataFrame([], "u BIGINT, v BIGINT")
    assert components.components(empty).count() == 0


ITEMS = "item_id BIGINT, text STRING, doc_id INT"


def test_decontamination(spark):
    rng = random.Random(3)
    pool = [f"k{n}" for n in range(40)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 30))).upper(), 0) for k in range(12)]
    items += [(50, None, 0), (51, " -- ", 0), (None, items[0][1], 0), (52, items[1][1], 0), (53, "Grüße, 東京 x", 0)]
    texts = [None, "", "?", "GRÜßE; grüße 東京-x end"]
    for _ in range(40):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 25))]
        taken = items[rng.randrange(12)][1].split()
        cut = rng.randrange(len(taken))
        parts[len(parts) // 2 : len(parts) // 2] = taken[cut : cut + rng.choice([9, 10, 11, 30])]
        texts.append(", ".join(parts))
    ids = [*range(len(texts)), 3, None]
    texts += [texts[3], texts[5]]
    docs = frame(spark, texts, ids).withColumnRenamed("block", "words")
    benchmark = spark.createDataFrame(items, ITEMS)
    found = decontaminate.contamination(docs, benchmark).drop("body")
    want = brute.contamination(list(zip(ids, texts)), [i[:2] for i in items])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    clean = decontaminate.contamination(docs, benchmark.limit(0))
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(ids)
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    items = [(k, " ".join(f"v{rng.randrange(30)}" for _ in range(25)), 0) for k in range(6)]
    texts = [f"x {items[k % 6][1]} y v1 v2" for k in range(8)]
    benchmark, docs = spark.createDataFrame(items, ITEMS), frame(spark, texts)
    whole = sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 4000)
    assert sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect())) == whole
    fingerprints, _ = decontaminate.benchmark_fingerprints(benchmark)
    dealt, blocks = decontaminate.broadcast_blocks(fingerprints)
    assert blocks > 2 and dealt.count() == fingerprints.distinct().count()
    assert dealt.select("block").distinct().count() > 2
    largest = dealt.groupBy("block").agg(
        F.sum(F.octet_length(F.array_join("around", " ")) + 128).alias("bytes")
    ).agg(F.max("bytes")).first()[0]
    assert largest <= decontaminate.BROADCAST_BYTES


def test_blocks_of_one_hash_are_split(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 2000)
    text = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(k, text, 0) for k in range(60)], ITEMS)
    dealt, blocks = decontaminate.broadcast_blocks(decontaminate.benchmark_fingerprints(benchmark)[0])
    assert blocks > 5 and dealt.select("hash").distinct().count() == 1
    row = decontaminate.contamination(frame(spark, [f"so {text} on"]), benchmark).first()
    assert (row.n_hit, row.n_items) == (10, 60)


def test_many_blocks_of_a_partition_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = [(k, f"w{k // 2} a{k // 2} b{k // 2} c{k // 2} d{k // 2}" + " e" * (k % 2)) for k in range(3300)]
        docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
        found = jaccard_join.jaccard_components(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.doc_id, r.component_id) for r in found) == [(k, k) for k in range(3300)]


def test_block_numbers_end_with_an_error():
    assert jaccard_join._numbered(1, 0) == jaccard_join._numbered(0, (1 << 24) - 1) + 1
    with pytest.raises(OverflowError):
        jaccard_join._numbered(0, 1 << 24)
    with pytest.raises(OverflowError):
        jaccard_join._numbered(1 << 23, 0)
