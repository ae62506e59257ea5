"""URL filter and archives."""

import base64
import hashlib
import random

import zstandard

from textmason.llm import url_filter, warc

PAGES = "page_id BIGINT, url STRING, html STRING, host STRING, template STRING, digest STRING, salt INT"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "d", 0) for r in rows], PAGES)


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/x": ("", "", None, "allow"),
        "http://NET/": ("net", "/", "net/", "block"),
        "http://a.NeT/x?y#z": ("a.net", "/x", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "https://b.Example.net/en/1": ("b.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/en": ("example.net", "/en", "net/", "block"),
        "x://example.com/de/?q": ("example.com", "/de/", "example.com/de/", "block"),
        "x://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "x://org/fr/a://b": ("org", "/fr/a://b", "org/fr/", "allow"),
        "://h#f": ("h", "", None, "allow"),
        "http://ÄB.org/fr/É": ("Äb.org", "/fr/É", "org/fr/", "allow"),
        "a\nb://q.net/l\nm": ("q.net", "/l\nm", "net/", "block"),
    }
    rows = [(k, url, None) for k, url in enumerate(cases)]
    found = url_filter.filter_urls(frame(spark, rows + rows[:1]))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()]
    want = [(k, *case) for k, case in enumerate(cases.values())]
    assert sorted(got) == sorted(want + want[:1])
    assert url_filter.filter_urls(frame(spark, rows).limit(0)).count() == 0


def test_templates_spread_the_labels_of_a_branch(spark):
    rules = (("h.org/ads/a", "block"), ("h.org/news/1", "allow"))
    paths = [f"/ads/a{k}" for k in range(40)] + ["/ads/b", "/ads/c"]
    paths += [f"/news/1{k}" for k in range(30)] + ["/news/2", "/other/x/1/2/3/4"]
    rows = [(k, f"http://h.org{path}", None) for k, path in enumerate(paths)]
    found = {r.path: r for r in url_filter.filter_urls(frame(spark, rows), rules).collect()}
    assert found["/ads/b"].template == "/ads/*" and found["/ads/b"].verdict == "block"
    assert found["/news/2"].template == "/news/*" and found["/news/2"].verdict == "allow"
    assert found["/other/x/1/2/3/4"].template == "/other/x/1/2/**"


def test_branches_below_the_named_levels_are_judged_apart(spark):
    rules = (("h.org/de/", "block"), ("h.org/k", "allow"))
    paths = [f"/de/x/y/z/spam/{k}" for k in range(10)] + [f"/k{k}" for k in range(8)]
    paths += ["/fr/x/y/z/help/1", "/fr/x/y/z/spam/a"]
    rows = [(k, f"http://h.org{path}", None) for k, path in enumerate(paths)]
    found = {r.path: r for r in url_filter.filter_urls(frame(spark, rows), rules).collect()}
    assert found["/fr/x/y/z/help/1"].template == "/*/x/y/z/**"
    assert (found["/fr/x/y/z/help/1"].verdict, found["/fr/x/y/z/help/1"].purity) == ("allow", 0.5)
    assert found["/fr/x/y/z/spam/a"].verdict == "block" and len(found) == len(rows)


def test_branches_part_at_the_sixth_level(spark):
    top = "/a/b/c/d/e"
    rules = ((f"h.org{top}/spam/x", "block"), (f"h.org{top}/good/x", "allow"))
    paths = [f"{top}/spam/x{k}" for k in range(40)] + [f"{top}/good/x{k}//q" for k in range(30)]
    paths += [f"{top}/spam/z", f"{top}/good/z/q", *["/1/2/3/4/5/6/7/8/9"] * 12, "/", ""]
    rows = [(k, f"http://h.org{path}", None) for k, path in enumerate(paths)]
    found = url_filter.filter_urls(frame(spark, rows), rules).collect()
    verdicts = {r.path: r.verdict for r in found}
    assert len(found) == len(rows)
    assert verdicts[f"{top}/spam/z"] == "block" and verdicts[f"{top}/good/z/q"] == "allow"
    grown = url_filter.templates(frame(spark, rows).selectExpr("'h' AS host", "substr(url, 13) AS path"))
    nodes = {(r.path, r.parent, r.node) for r in grown.collect()}
    assert (f"{top}/good/z/q", f"{top}/good/*", f"{top}/good/*/q") in nodes
    assert ("/1/2/3/4/5/6/7/8/9", "/1/2/3/4/5/6/7/8", "/1/2/3/4/5/6/7/8/9") in nodes
    assert ("", "", "") in nodes and ("/", "", "") in nodes


def grown_by_levels(paths):
    """(path, parent, node) of one host's paths, one level at a time."""
    parts = {path: [s for s in path.split("/") if s] for path in paths}
    places = [[path, "", ""] for path in paths]
    for level in range(max(map(len, parts.values()), default=0)):
        below = {}
        for path, _, node in places:
            if len(parts[path]) > level:
                below.setdefault(node, []).append(parts[path][level])
        for place in places:
            path, _, node = place
            if len(parts[path]) > level:
                kids = below[node]
                varies = len(set(kids)) >= url_filter.MANY_CHILDREN and (
                    len(kids) < url_filter.ROWS_EACH * len(set(kids)))
                step = "*" if varies else parts[path][level]
                place[1:] = node, f"{node}/{step}"
    return sorted(map(tuple, places))


def grown(spark, paths):
    rows = spark.createDataFrame([("h", path) for path in paths], "host STRING, path STRING")
    found = url_filter.templates(rows)
    assert found.columns == ["host", "path", "parent", "node", "template"]
    return sorted((r.path, r.parent, r.node) for r in found.collect())


def test_trees_are_those_grown_by_levels(spark):
    rng = random.Random(5)
    for choices in ("a", "ab", "abcdefghijklmnop", "aaaaaaaab"):
        paths = [
            "/" + "/".join(rng.choice(choices) + rng.choice(["", "", "/"]) for _ in range(rng.randrange(9)))
            for _ in range(150)
        ]
        paths += ["/x/y/z/" + rng.choice(["", "u", "u/v", "u/v/w"]) for _ in range(40)]
        paths += [f"/x/y/k/{rng.randrange(30)}/m/n/{rng.choice('pq')}" for _ in range(40)]
        paths += ["/x/\U0010ffff\U0010ffff/1", "/x/\U0010ffff/1"] * 9
        assert grown(spark, paths) == grown_by_levels(paths)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(
        url_filter, "cut_lineage", lambda df, cut=url_filter.cut_lineage: stored.append(1) or cut(df)
    )
    paths = ["/a" * k for k in range(0, 400, 3)] * 3 + ["/a" * 200 + f"/b{k}" * 50 for k in range(4)] * 9
    assert grown(spark, paths) == grown_by_levels(paths)
    assert len(stored) <= 5


def test_archives(spark, tmp_path):
    rng = random.Random(1)
    bodies = ["", None, "<p>é</p>", *("<html>" + "".join(rng.choice("abc <>") for _ in range(300)) for _ in range(9))]
    rows = [(k, f"http://h/{k}", rng.choice(bodies)) for k in range(200)]
    rows += [(500, None, "alone"), (501, "http://h/a\r\nX: y", "alone too"), (None, "http://h", "<p>é</p>"), rows[7]]
    stored = warc.write_archives(warc.with_revisits(frame(spark, rows)))
    found = warc.read_archives(stored).collect()
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        top = largest.get(html or "")
        same = page == top
        want.append((page, len(raw), digest, "response" if same else "revisit", None if same else top))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    for row in stored.collect():
        records = warc.read_archive(bytes(row.archive))
        assert len(records) == row.n_records
    names = warc.export_archives(stored, str(tmp_path / "out")).collect()
    assert len(list((tmp_path / "out").iterdir())) == len(names)


def test_small_payloads_are_never_revisits(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    found = warc.read_archives(warc.write_archives(warc.with_revisits(frame(spark, rows), least_bytes=3)))
    assert {r.page_id: r.refers_to for r in found.collect()} == {1: None, 2: None, 3: 4, 4: None}
    empty = warc.with_revisits(frame(spark, rows).limit(0))
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_records_are_frames_of_their_own():
    records = [f"record {k} with some shared text".encode() * 20 for k in range(50)]
    data = warc.write_archive(records)
    size = int.from_bytes(data[4:8], "little")
    known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    at, plain = 8 + size, []
    while at < len(data):
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        plain.append(one.decompress(data[at:]))
        at = len(data) - len(one.unused_data)
    assert plain == records
