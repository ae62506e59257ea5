"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import string

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_by_blank(text):
    return (text or "").encode("utf-8").split()


def benchmark_words(text):
    out, word = [], []
    for c in (text or "").translate(UPPER) + " ":
        if c in string.ascii_lowercase + string.digits or c >= "\x80":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out


def removed(texts, length=100):
    """Texts in document order -> (n_bytes, n_removed, n_spans, sha256 of the rest) each."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode("utf-8")
        marks = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            part = raw[i : i + length]
            if part in seen:
                marks[i : i + length] = b"\1" * length
            seen.add(part)
        rest = bytes(b for b, m in zip(raw, marks) if not m)
        spans = sum(1 for i, m in enumerate(marks) if m and (i == 0 or not marks[i - 1]))
        out.append((len(raw), sum(marks), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def shingles(text, n=5):
    words = words_by_blank((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_groups(rows):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id)]."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return [
        (doc_id, len(sets[k]), least.get(root(k)) if sets[k] else doc_id)
        for k, (doc_id, _) in enumerate(rows)
    ]


def contamination(rows, items):
    """[(doc_id, text)], [(item_id, text)] -> rows of the operator."""
    windows = []
    for item_id, text in items:
        words = benchmark_words(text)
        size = min(len(words), 10)
        windows += [(item_id, words[k : k + size]) for k in range(len(words) - size + 1) if size]
    out = []
    for doc_id, text in rows:
        words, hit, found = benchmark_words(text), set(), set()
        for item_id, window in windows:
            for s in range(len(words) - len(window) + 1):
                if words[s : s + len(window)] == window:
                    hit.update(range(s, s + len(window)))
                    if item_id is not None:
                        found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def repetition(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = [w.decode("utf-8") for w in words_by_blank(text)]
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    repeated = {k + j for starts in places.values() if len(starts) > 1 for k in starts for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words_by_blank(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)
