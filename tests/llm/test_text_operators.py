"""Operators that read each text by itself."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers

import brute
from textmason.llm import byte_bpe, licenses, quality, token_counts, token_files

DOCS = "doc_id BIGINT, text STRING, lang STRING, kept STRING, rest INT, words INT, body INT, block INT"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aab b'sSt \n\t\x1c\x85  éßΣς中文字1२½_-😀\u0301\r"


def some_texts():
    rng = random.Random(5)
    line = "the same line of words again and again here"
    return [
        None, "", " \t\n", "one", "a b c", "\n".join([line] * 5), " ".join(["x"] * 60),
        " ".join(str(k) for k in range(300)), "é # <b> $5 & 7% | *" * 3, "z" * 20_000,
        "İΣ ΑΣ ﬁ <|endoftext|> x", "This is\nLicensed under CC BY-NC 4.0. More text.\n",
        *("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 80))) for _ in range(60)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, text, None, "x", 1, 2, 3, 4) for k, text in enumerate(some_texts())]
    rows += [rows[5], (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_quality(docs):
    rows = docs.collect()
    found = sorted(map(tuple, quality.repetition_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    ).collect()), key=str)
    assert found == sorted(((r.doc_id, *brute.repetition(r.text)) for r in rows), key=str)
    whole = quality.repetition_quality(docs, carry=True).select("rest.*")
    assert whole.columns == docs.columns and whole.count() == len(rows)
    assert quality.repetition_quality(docs.limit(0)).count() == 0


def test_quality_keeps_plain_text_and_rejects_repetition():
    rng = random.Random(1)
    plain = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400))
    counts = dict(zip(quality.COUNTS, quality.measure(plain.encode())))
    assert counts["chars_5"] == counts["line_chars"] == 0
    counts = dict(zip(quality.COUNTS, quality.measure(("one two three four five six. " * 40).encode())))
    assert 100 * counts["chars_10"] > 10 * counts["word_chars"]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality, "_BASE", np.uint64(1))  # order no longer counts in a hash
    words = " ".join(f"{a} {b} {c} {d} {e}" for a, b, c, d, e in
                     [("p", "q", "r", "s", "t"), ("t", "s", "r", "q", "p"), ("p", "q", "r", "s", "t")])
    counts = dict(zip(quality.COUNTS, quality.measure(words.encode())))
    assert counts["chars_5"] == 5


def test_licenses(spark):
    text = [
        None, "", "Licensed under CC BY-NC 4.0.", "Words. Released under the MIT License.\nLicensed under the Apache License, Version 2.0.",
        "Permission is hereby granted, free of charge", "All rights reserved", "ALL RIGHTS RESERVED!",
        "This program is free software; nothing else.",
    ]
    rows = [(k, t, "x") for k, t in enumerate(text)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id INT, text STRING, licenses STRING"))
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in found.collect()}
    assert got == {
        0: (0, ""), 1: (0, ""), 2: (1, "CC-BY-NC-4.0"), 3: (2, "MIT,Apache-2.0"), 4: (0, ""),
        5: (1, "Proprietary"), 6: (1, "Proprietary"), 7: (1, ""),
    }
    rules = (("both", ("a", "b")), ("reverse", ("b", "a")))
    known = {"a": "first", "b": "second"}
    one = spark.createDataFrame([(1, "First. Other.\nSecond.")], "doc_id INT, text STRING")
    assert licenses.scan_licenses(one, known, rules).first().licenses == "both"


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def commented(text, mark):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())


def test_wrapped_licenses(spark):
    cases = {
        MIT: "MIT", MIT.replace("\n", "\r\n"): "MIT", "/*\n" + commented(MIT, " *") + " */\n": "MIT",
        commented(MIT, "#"): "MIT", MIT.replace("charge", "cost"): "",
        BSD: "BSD-2-Clause", BSD_3: "BSD-3-Clause,BSD-2-Clause",
        BSD.replace("1. R", "* R").replace("2. R", "* R"): "BSD-2-Clause",
        commented(BSD_3, "//"): "BSD-3-Clause,BSD-2-Clause",
        BSD_3.replace(".\n", "\n"): "BSD-3-Clause,BSD-2-Clause",
        GPL.format(";", ";", 2): "GPL-2.0-or-later", GPL.format(":", ",", 3): "GPL-3.0-or-later",
        "This project is released under the MIT License.": "MIT",
        "All of it is\nlicensed under\nthe MIT license, see there": "MIT",
        "Released under the\n\nMIT License": "", "released under the mit licenses": "",
        "unreleased under the MIT License": "", "Released under the. MIT License": "",
        "Sold by One, Inc. All rights\nreserved": "Proprietary",
    }
    rows = [(k, t) for k, t in enumerate(cases)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id INT, text STRING"))
    assert {r.doc_id: r.licenses for r in found.collect()} == dict(enumerate(cases.values()))
    known = {"long": "a b c", "short": "a b", "other": "c d", "one": "ab"}
    one = spark.createDataFrame([(1, "a b c d x a b d ab c d. a\nb")], "doc_id INT, text STRING")
    row = licenses.scan_licenses(one, known, (("r", ("long", "short")),)).first()
    assert (row.sentence_ids, row.n_sentences) == ("long,short,one,other,short", 5)


def test_byte_bpe(docs):
    codec = byte_bpe.codec_of(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    whole = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = decoded.collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert np.frombuffer(row.ids, "<u4").tolist() == whole.encode_ordinary(texts[row.doc_id])
        assert row.decoded == texts[row.doc_id].encode("utf-8")
    for text in ("a" * 3000, "aab" * 900, "=" * 777, "中" * 500, " " * 99, "ab" * 2000):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == whole.encode_ordinary(text)
    digests = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert digests.count() == docs.count()
    assert byte_bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pre_tokens_that_share_a_queue_are_merged_alike():
    codec = byte_bpe.codec_of(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(8)
    pieces = [b"a" * k for k in range(1, 60)] + ["".join(
        rng.choice("aabbeinstr é中") for _ in range(rng.randint(1, 40))).encode() for _ in range(3000)]
    packed = codec.merge_all(pieces)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in packed] == [codec.merge(p) for p in pieces]


def test_memory_of_pre_tokens_changes_nothing(monkeypatch):
    codec = byte_bpe.ByteBpe(byte_bpe.codec_of(open(RANKS, "rb").read(), public_tokenizers.PATTERN).ranks,
                             public_tokenizers.PATTERN)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(200))
             for _ in range(20)] + ["x" * 400 + " y", ""]
    whole = [codec.encode(text) for text in texts]
    monkeypatch.setattr(byte_bpe, "MEMORY_TOKENS", 50)
    monkeypatch.setattr(byte_bpe, "STEP_TOKENS", 64)
    monkeypatch.setattr(byte_bpe, "STEP_IDS", 7)
    codec.known, codec.before = {}, {}
    assert codec.encode_all(texts) == whole == [codec.encode(text) for text in texts]
    assert [codec.decode(ids) for ids in whole] == [text.encode() for text in texts]


def test_rank_queue_gives_the_lowest_rank_and_position():
    queue, rng, kept = byte_bpe.RankQueue(60_000), random.Random(2), []
    for _ in range(4000):
        if kept and rng.random() < 0.45:
            kept.sort()
            assert queue.pop() == kept.pop(0)
        else:
            kept.append((rng.randrange(60_000) if rng.random() < 0.5 else 7, rng.randrange(99)))
            queue.push(*kept[-1])
    assert [queue.pop() for _ in kept] == sorted(kept) and queue.pop() is None


def test_token_counts(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [
        (model.id_to_piece(k), 0.0 if model.is_control(k) or model.is_unknown(k) or model.is_byte(k)
         else float(model.get_score(k))) for k in range(len(model))
    ]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, True))
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, PIECES).collect()}
    for row in docs.collect():
        text = row.text or ""
        if "<" in text:
            continue  # the library also matches the names of its control pieces
        want = len(library.encode("▁" + text.replace(" ", "▁")).ids) if text else 0
        assert (found[row.doc_id].n_tokens, found[row.doc_id].n_chars) == (want, len(text))


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_ties_go_to_the_longest_last_piece(byte_pieces):
    rng = random.Random(3)
    pieces = [("a", -1.0), ("b", -2.0), ("ab", -3.0), ("ba", -3.0), ("aba", -4.0), ("▁", -1.0), ("▁a", -2.0)]
    vocabulary = [("<unk>", 0.0)] + pieces
    if byte_pieces:
        vocabulary += [(f"<0x{k:02X}>", 0.0) for k in range(256)]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, byte_pieces))
    counter = token_counts.UnigramCounter(pieces, byte_pieces)
    counter.unknown = min(s for _, s in vocabulary) - 10
    for _ in range(300):
        text = "".join(rng.choice("aabb cé") for _ in range(rng.randint(1, 25)))
        assert counter.count(text) == len(library.encode("▁" + text.replace(" ", "▁")).ids)


@pytest.mark.parametrize("mark", [True, False])
@pytest.mark.parametrize("byte_pieces", [True, False])
def test_unknown_runs_go_on_across_marks(byte_pieces, mark):
    pieces = [("a", -1.0), ("b", -2.0), ("ab", -3.0)] + [("▁", -1.5)] * mark
    vocabulary = [("<unk>", 0.0)] + pieces
    if byte_pieces:
        vocabulary += [(f"<0x{k:02X}>", 0.0) for k in range(256)]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, byte_pieces))
    counter = token_counts.UnigramCounter(pieces, byte_pieces)
    counter.unknown = min(s for _, s in vocabulary) - 10
    for text in ("é é", "é b é", "éé  é a é", "a b ab", " é ", "b é é b"):
        assert counter.count(text) == len(library.encode("▁" + text.replace(" ", "▁")).ids)


def test_token_files(docs, spark):
    shards = token_files.write_tokens(docs, WORDS, end_id=1)
    found = sorted(token_files.read_tokens(shards).collect(), key=lambda r: r.start)
    library = tokenizers.Tokenizer.from_file(WORDS)
    texts = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()),
                   key=lambda r: (r[0], r[1] or 0))
    assert [r.doc_id for r in found] == [doc_id for _, doc_id, _ in texts]
    start = 0
    for row, (_, _, text) in zip(found, texts):
        assert row.start == start
        assert row.n_tokens == 1 + len(library.encode(text, add_special_tokens=False).ids)
        start += row.n_tokens
    ids = [k for row in shards.orderBy("part", "shard").collect()
           for k in token_files.TokenShard(bytes(row.code)).all().tolist()]
    assert ids == [k for _, _, text in texts
                   for k in library.encode(text, add_special_tokens=False).ids + [1]]
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), WORDS)).count() == 0


def test_random_access():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32) >> rng.integers(0, 32, n, dtype=np.uint32)
        shard = token_files.TokenShard(token_files.pack(ids))
        assert len(shard) == n and (shard.all() == ids).all()
        assert all(shard[k] == ids[k] for k in range(0, n, 7))
    with pytest.raises(IndexError):
        shard[n]


def test_matches_come_longest_first():
    """Segmentation relies on it: among equal scores the longest last piece wins."""
    rng = random.Random(8)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        scored = [(piece, rng.choice((-1.0, -2.0, -3.0))) for piece in pieces]
        counter = token_counts.UnigramCounter(scored, True)
        text = "".join(rng.choice("abcd") for _ in range(12))
        found = [(end, -length) for end, (length, _) in counter.automaton.iter(text)]
        assert found == sorted(found)
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            ends = [(len(p), v) for p, v in scored if text[:end].endswith(p)]
            options = [(best[end - n][0] + v, n, best[end - n][1] + 1) for n, v in ends]
            if all(n > 1 for n, _ in ends):
                options.append((best[end - 1][0] + counter.unknown, 0, best[end - 1][1] + 1))
            score, _, count = max(options)
            best.append((score, count))
        assert counter.segment(text) == best[-1][1]
