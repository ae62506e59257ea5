"""Source divergence, whitening and language identification."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textmason.llm import divergence, language_id, whitening
from textmason.llm.queries import QUERIES

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n BIGINT, total INT, tile INT, rank INT, part STRING"
SF_DIR = "/root/testdata/sf0.001"


# -- source divergence ------------------------------------------------------------------


def brute_divergence(rows, least=3, top=200):
    """[(text, lang, source)] -> set of (lang, source, part, item, value, rank)."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    counts, found = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        found[lang or ""].update(set(terms))
    out = set()
    for lang in found:
        kept = [t for t, n in found[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        shares = {s: share(c) for s, c in groups.items()}
        whole = share(sum(groups.values(), Counter()))
        for s, p in shares.items():
            parts = {
                "pair": [(x, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for x, q in shares.items() if x != s],
                "term": [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if groups[s][t] and p[t] > whole[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for k, (item, value) in enumerate(items[: top if part == "term" else None], 1):
                    out.add((lang, s, part, item, value, k))
    return out


def some_documents():
    rng = random.Random(4)
    words = ["é", "É", "ß", "日本", "The", "the", "a_b", "x1y"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    rows = [(None, None, None), ("", "en", "empty"), (None, "none", "s1"), ("12 34", "none", "s2"),
            ("only once here", "few", "s1"), ("other words", "few", "s2"), ("the " * 200_000, "en", "s1")]
    for k in range(150):
        size = rng.choice([1, 5, 40])
        rows.append((" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=size)),
                     rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "", None])))
    return rows + rows[-3:]


@pytest.mark.parametrize("block, tile", [(4096, 32), (8, 2)])
def test_divergence(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = some_documents()
    docs = spark.createDataFrame([(k, *r, 1, 2, 3, 4, "x") for k, r in enumerate(rows)], DOCS)
    found = list(map(tuple, divergence.source_divergence(docs).collect()))
    assert set(found) == brute_divergence(rows) and len(found) == len(set(found))
    short = set(map(tuple, divergence.source_divergence(docs, least_documents=5, top_terms=2).collect()))
    assert short == brute_divergence(rows, 5, 2)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_trees_share_nodes_and_pairs_are_priced_once():
    counts = np.tile(np.array([0, 1, 0, 0]), (2, 256))
    _, levels, roots = divergence.build_trees(counts)
    assert roots[0] == roots[1] and sum(len(lower) for lower, _, _ in levels) == 2 + 9
    place, left, right, times = divergence.walk_pairs(levels, roots[0], roots[1:])
    assert sorted(times.tolist()) == [256, 768] and (left == right).all() and (place == 0).all()


def test_shares_don_t_overflow():
    counts = np.array([0, 7, 10**13, 9 * 10**12])
    total = 9 * 10**12 + 1234567
    counts[2] = total - 1
    want = [1 + 10**9 * (int(c) + 1) // total for c in counts]
    assert divergence.scaled(counts, total).tolist() == want


def test_prices_of_counts_in_blocks_are_those_of_columns(spark):
    rows = [(0, 5), (6, 9_999), (10**12, 10**12 + 5)]
    df = spark.createDataFrame(rows, "n BIGINT, total BIGINT").select(divergence._scaled("n", "total").alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (n + 1) // t for n, t in rows]


# -- whitening ----------------------------------------------------------------------------


def dense_whitening(vectors, k=4):
    """(n, deviations, whitened, explained) of integer vectors, by an eigenvalue routine."""
    fit = np.unique(vectors, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviations = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums)) for x in vectors]
    return n, deviations, (vectors - sums / n) @ axes / np.sqrt(values), values / centred.var(axis=0).sum()


def check_whitening(found, ids, vectors, k=4):
    n, deviations, whitened, explained = dense_whitening(vectors, k)
    assert len(found) == len(ids) * k
    rows = sorted(found, key=lambda r: (r.component, r.vec_id, r.whitened))
    for c in range(k):
        mine = rows[c * len(ids) : (c + 1) * len(ids)]
        assert {r.component for r in mine} == {c + 1} and {r.n for r in mine} == {n}
        got = {}
        for r in mine:
            got.setdefault(r.vec_id, []).append((r.deviation, r.whitened))
        at = np.argmax(np.abs(whitened[:, c]))
        sign = np.sign(whitened[at, c]) * np.sign(min(got[ids[at]], key=lambda x: abs(abs(x[1]) - abs(whitened[at, c])))[1])
        for vec_id in set(ids):
            want = sorted((deviations[j], sign * whitened[j, c]) for j in range(len(ids)) if ids[j] == vec_id)
            assert [d for d, _ in sorted(got[vec_id])] == [d for d, _ in want]
            np.testing.assert_allclose([w for _, w in sorted(got[vec_id])], [w for _, w in want], atol=1e-9)
        assert all(abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine)


EMBEDDINGS = "vec_id BIGINT, embedding ARRAY<FLOAT>, x INT, component INT, part INT"


def test_whitening(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 40)) * np.linspace(0.5, 1, 40) + 0.3
    vectors[7] = vectors[8]
    rows = [(k, [float(np.float32(c)) for c in v], 1, 2, 3) for k, v in enumerate(vectors)]
    bad = [(900, None, 1, 2, 3), (901, [1.0] * 39 + [None], 1, 2, 3), (902, [float("nan")] * 40, 1, 2, 3),
           (903, [float("inf")] + [0.0] * 39, 1, 2, 3)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows + bad, EMBEDDINGS)
    whole = np.array([np.floor(256 * np.array(r[1])) for r in rows]).astype(np.int64)
    check_whitening(whitening.whiten(df).collect(), [r[0] for r in rows], whole)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id >= 900")).count() == 0


def test_whitening_in_passes_reaches_close_eigenvalues(spark):
    """Far fewer passes than dimensions, small eigenvalues below the first interval, near ties."""
    rng = np.random.default_rng(2)
    spread = np.concatenate([[9, 4, 3.02, 3.0, 2.99], np.linspace(2, 1, 60), np.full(35, 0.05)])
    turn = np.linalg.qr(rng.standard_normal((100, 100)))[0]
    vectors = (rng.standard_normal((3000, 100)) * spread) @ turn
    df = spark.createDataFrame([(k, v.tolist(), 1, 2, 3) for k, v in enumerate(vectors)], EMBEDDINGS)
    whole = np.floor(256 * vectors.astype(np.float32).astype(float)).astype(np.int64)
    check_whitening(whitening.whiten(df).collect(), list(range(3000)), whole)


@pytest.mark.parametrize("vectors, components", [
    ([[1.0, 2.0]], 2), ([[1.0, 2.0], [1.0, 2.0]], 2), ([[1.0], [3.0], [5.0]], 1), ([[]], 0),
    ([[1.0, 2.0, 3.0], [1.0]], 3), ([[0.0] * 30, [1.0] * 30, [2.0] * 30], 4), ([[1e20, 0.0], [0.0, -1e20]], 2),
])
def test_whitening_of_odd_tables(spark, vectors, components):
    df = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in enumerate(vectors)], EMBEDDINGS)
    rows = whitening.whiten(df).collect()
    assert len(rows) == len(vectors) * components
    for row in rows:
        assert np.isfinite([row.whitened, row.explained, row.identity_error]).all()
        assert row.identity_error < 1e-4 and (row.explained > 0 or row.whitened == 0)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    whole = np.array([np.floor(256 * np.array(r.embedding, float)) for r in rows]).astype(np.int64)
    check_whitening(QUERIES["op12_whitening"](spark, SF_DIR).collect(), [r.vec_id for r in rows], whole)


def test_deviations_beyond_a_long_are_null():
    x = np.array([[2**40, 0], [0, 1]])
    assert whitening._deviations(x, 2, [2**40, 1]) == [None, None]
    assert whitening._deviations(x[1:], 2, [0, 2]) == [0]


# -- language identification ---------------------------------------------------------------


def test_language_id_of_the_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op13_language_id"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    learnt = {r.lang for r in docs.values()}
    right = total = 0
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1
        letters = any(map(str.isalpha, docs[row.doc_id].text or ""))
        assert (row.lang_pred == "und") == (not letters) and row.lang_pred in learnt | {"und"}
        if row.held_out and letters:
            total += 1
            right += row.lang_pred == docs[row.doc_id].lang
    assert total > 50 and right >= 0.95 * total


def test_language_id_defined_cases(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, score INT, held_out INT, _text INT, hash INT"
    rows = [(k, f"the cat and the dog went there number {k}", "en", 1, 2, 3, 4) for k in range(30)]
    rows += [(k, f"der Hund und die Katze gehen über die Brücke {k}", "de", 1, 2, 3, 4) for k in range(30, 60)]
    odd = [(60, None, "en", 1, 2, 3, 4), (61, "", "de", 1, 2, 3, 4), (62, "12 %$ €", None, 1, 2, 3, 4),
           (None, "the dog and the cat", None, 1, 2, 3, 4), (63, "日本語", None, 1, 2, 3, 4),
           (64, "the cat " * 400_000, None, 1, 2, 3, 4), (65, "zzz", None, 1, 2, 3, 4), rows[0]]
    df = spark.createDataFrame(rows + odd, schema)
    found = language_id.predict_languages(df).collect()
    assert len(found) == len(rows) + len(odd)
    got = {r.doc_id: r for r in found}
    assert all(got[k].lang_pred == ("en" if k < 30 else "de") for k in range(60))
    assert [got[k].lang_pred for k in (60, 61, 62)] == ["und"] * 3 and got[60].score == 0 and got[60].rejected
    assert got[None].lang_pred == got[64].lang_pred == "en" and got[63].lang_pred in ("de", "en")
    assert got[63].rejected and not got[1].rejected
    model = language_id.learn(df.select("lang", "text"))
    rejected = language_id.identify(df.filter("doc_id = 63"), model, reject=True).first()
    assert rejected.lang_pred == "und" and rejected.rejected
    assert language_id.predict_languages(df.limit(0)).count() == 0
    nothing = language_id.predict_languages(df.filter("lang IS NULL")).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}


def test_counts_don_t_depend_on_the_step(monkeypatch):
    raw = "Größe, the cat; über 12 dogs".encode() * 50
    whole = language_id.gram_counts(raw)
    monkeypatch.setattr(language_id, "STEP_BYTES", 7)
    assert (language_id.gram_counts(raw) == whole).all()
    spaced = 1 + len(b" ".join(raw.translate(language_id._LETTERS).split())) + 1
    assert whole.sum() == spaced + spaced - 1 + spaced - 2


def test_a_language_has_several_centroids():
    rng = np.random.default_rng(0)
    parts = [np.eye(8)[k] + 0.05 * rng.random((40, 8)) for k in (0, 3, 5)]
    found = language_id.clusters(language_id._unit(np.vstack(parts)), 4)
    nearest = {int(np.abs(found @ language_id._unit(p.mean(axis=0, keepdims=True)).T).argmax()) for p in parts}
    assert len(nearest) == 3


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = spark.createDataFrame([(c, "some text") for c in "abc"], "lang STRING, text STRING")
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(rows)
