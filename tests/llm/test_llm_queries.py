"""Registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import brute
import corpus_pipeline
from oracle import compare
from textmason.llm import byte_bpe, quality
from textmason.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    rows, problem = compare(spark, SF_DIR, QUERIES[name], ORACLES[name])
    assert problem is None and rows > 0


def tables(spark):
    return [
        [(r.doc_id, r.text, r.lang, r.source, r.n_chars)
         for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()],
        [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()],
    ]


def test_suffix_dedup_and_jaccard_of_the_table(spark):
    docs = sorted(tables(spark)[0])
    found = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, SF_DIR).collect()}
    for (doc_id, *_), want in zip(docs, brute.removed([d[1] for d in docs])):
        row = found[doc_id]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == want[:4]
    rows = QUERIES["op10_jaccard_join"](spark, SF_DIR).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.jaccard_groups([d[:2] for d in docs]))


def test_token_files_of_the_table(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r for r in QUERIES["op7_token_files"](spark, SF_DIR).collect()}
    start = 0
    for doc_id, text, *_ in sorted(tables(spark)[0]):
        n = 1 + len(library.encode(text, add_special_tokens=False).ids)
        assert (found[doc_id].start, found[doc_id].n_tokens) == (start, n)
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert found[doc_id].ids_crc32 == zlib.crc32(ids.tobytes())
        start += n


def test_byte_bpe_of_the_table(spark):
    ranks = byte_bpe.codec_of(
        open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN
    ).ranks
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    found = {r.doc_id: r for r in QUERIES["op8_byte_bpe"](spark, SF_DIR).collect()}
    docs = tables(spark)[0]
    assert len(found) == len(docs)
    for doc_id, text, *_ in docs:
        ids, row = library.encode_ordinary(text or ""), found[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def kept_by_quality(rows):
    out = []
    for row in rows:
        counts = dict(zip(quality.COUNTS, quality.measure((row[1] or "").encode())))
        bad = brute.repetition(row[1])[-1] or any(
            100 * counts[f"chars_{n}"] > p * counts["word_chars"] for n, p in quality.MOST_REPEATED.items()
        ) or 100 * counts["line_chars"] > quality.MOST_LINES * counts["word_chars"]
        if not bad:
            out.append(row)
    return out


def test_pipeline(spark):
    rows, items = tables(spark)
    rows = kept_by_quality(sorted(rows))
    groups = {d: c for d, _, c in brute.jaccard_groups([r[:2] for r in rows])}
    rows = [r for r in rows if groups[r[0]] == r[0]]
    texts = [w[4].decode("utf-8", "ignore") for w in brute.removed([r[1] for r in rows])]
    rows = [(r[0], t) for r, t in zip(rows, texts)]
    dirty = {r[0] for r in brute.contamination(rows, items) if r[5]}
    assert dirty
    ranks = byte_bpe.codec_of(
        open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN
    ).ranks
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = {
        d: (len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
        for d, t in rows if d not in dirty
    }
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in found} == want


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, _body INT, rest STRING"
    long = " ".join(f"word{k} of a long text" for k in range(60))
    rows = [(1, long, "en", "s", 1, 7, "r"), (1, long, "en", "s", 1, 7, "r"), (None, None, None, None, None, None, None),
            (2, "", "en", None, 0, 7, "r"), (3, long + " and more", None, None, 5, 8, None)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == frame.columns and json.loads(docs.schema.json())
        found = docs.collect()
        assert len(found) == (1 if frame.count() else 0)
        assert all(r._body == 7 and r.rest == "r" and r.text == long for r in found)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == len(found)
