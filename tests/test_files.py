"""Trees of real files, snapshots, reports and whole runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textmason.operators import graph, snapshots
from textmason.operators.evidence import plan_operations
from textmason.operators.rollups import report_summary
from textmason.operators.rules import RuleBook
from textmason.plans.migration import run_migration, select_project
from textmason.session import SHUFFLE_CLEANUP, cut_lineage, forget
from textmason.sources import files as tree
from textmason.sources import tables
from textmason.sources import tree as listing

ISSUED = "2024-01-01 00:00:00"


def issued():
    return F.lit(ISSUED).cast("timestamp")


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "source"
    contents = {
        "pkg/__init__.py": b"import a\n",
        "_x.py": b"x = 1\r\ny = 2\rz = 3\n",
        ".h.py": b"h = 1",
        "deep/er/est/d.js": "// é\n".encode(),
        "bad.py": b"\xff\xfe",
        "note.txt": b"text",
        "deep/data.bin": b"\x00\xff",
        "UPPER.PY": b"u = 1",
    }
    for name, data in contents.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (root / "loop").symlink_to(root)
    return root


def test_scan_keeps_hidden_names_and_normalises_newlines(spark, source):
    rows = {r.path: r for r in tree.scan_corpus(spark, str(source), project_id=4).collect()}
    assert set(rows) == {"pkg/__init__.py", "_x.py", ".h.py", "deep/er/est/d.js", "bad.py"}
    assert rows["_x.py"].content == "x = 1\ny = 2\nz = 3\n"
    assert rows["deep/er/est/d.js"].content == "// é\n"
    assert rows["bad.py"].content is None and "UnicodeDecodeError" in rows["bad.py"].error
    assert {r.project_id for r in rows.values()} == {4}
    kept = tree.readable(tree.scan_corpus(spark, f"file://{source}/"))
    assert kept.count() == 4


def test_scan_everything(spark, source):
    assert tree.scan_corpus(spark, str(source), code_only=False).count() == 8


def test_scan_single_file_has_no_suffix_filter(spark, source):
    rows = tree.scan_single_file(spark, str(source / "note.txt")).collect()
    assert [(r.path, r.content, r.error) for r in rows] == [("note.txt", "text", None)]
    missing = tree.scan_single_file(spark, str(source / "gone.py")).collect()
    assert missing[0].content is None and "FileNotFoundError" in missing[0].error


def test_scan_of_an_empty_folder(spark, tmp_path):
    assert tree.scan_corpus(spark, str(tmp_path)).count() == 0


def test_write_tree_and_copy_of_other_files(spark, source, tmp_path):
    target = tmp_path / "target"
    (target / "deep").mkdir(parents=True)
    (target / "note.txt").write_text("kept")
    (target / "blocked.py").mkdir()
    files = tree.readable(tree.scan_corpus(spark, str(source)))
    extra = spark.createDataFrame(
        [(0, 1, "blocked.py", "x", None), (0, 1, "none.py", None, None)], tree.FILES_SCHEMA
    )
    outcome = {r.path: r for r in tree.write_tree(files.unionByName(extra), str(target)).collect()}
    assert {p: r.status for p, r in outcome.items()} == {
        "pkg/__init__.py": "completed", "_x.py": "completed", ".h.py": "completed",
        "deep/er/est/d.js": "completed", "blocked.py": "failed", "none.py": "failed",
    }
    assert outcome["blocked.py"].error
    assert (target / "_x.py").read_bytes() == b"x = 1\ny = 2\nz = 3\n"
    copied = {r.path for r in tree.copy_missing(spark, str(source), str(target)).collect()}
    assert copied == {"deep/data.bin", "UPPER.PY"}
    assert (target / "deep/data.bin").read_bytes() == b"\x00\xff"
    assert (target / "note.txt").read_text() == "kept"
    assert not list(target.rglob("*.part"))


CODE = {
    "api.py": "import requests\ndef f(u):\n    return requests.get(u, timeout=30)\n",
    "client.py": "class C:\n    def __init__(self, timeout):\n        self.timeout = timeout\n"
                 "    def send(self, b):\n        return requests.post(U, data=json.dumps(b), timeout=120)\n",
    "utils.py": "def add(a, b):\n    return a + b\n",
    "w.js": "async function g(u) { return fetch(u) }",
}


def test_dry_run_writes_nothing(files, tmp_path):
    run = run_migration(files(CODE), issued(), target_root=str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    execution = run.execution.first()
    assert (execution.total_operations, execution.successful_operations) == (4, 4)
    assert run.summary.first().completed_operations == 0
    analysis = run.analysis.first()
    assert (analysis.total_files, analysis.entities, analysis.complexity_score) == (4, 5, 50)
    metrics = run.metrics.first()
    assert (metrics.entities, metrics.opportunities, metrics.operations) == (5, 2, 4)
    assert metrics.mean_confidence == pytest.approx((0.9 + (0.9 + 0.85) / 2) / 2)


def test_run_report_and_rollback(spark, files, tmp_path):
    root, report = str(tmp_path / "out"), str(tmp_path / "report")
    projects = spark.createDataFrame(
        [(1, "demo", "src", "out", None, "completed", None)],
        "project_id BIGINT, name STRING, source_path STRING, target_path STRING, "
        "created_at TIMESTAMP, status STRING, completed_at TIMESTAMP",
    )
    first = run_migration(files(CODE), issued(), dry_run=False, target_root=root, snapshot_id=1,
                          report_path=report, projects=projects)
    assert [tuple(r) for r in first.manifest.collect()] == [(1, 1, None)]
    assert first.execution.first().successful_operations == 4
    written = {r.path: r.content for r in tables.snapshot_files(spark, root, 1).collect()}
    assert written["utils.py"] == CODE["utils.py"]
    assert "timeout=30*1000" in written["api.py"]
    assert "self.timeout = timeout * 1000\n" in written["client.py"]
    assert "json=b, timeout=120)" in written["client.py"]

    migrated = tables.snapshot_files(spark, root, 1)
    second = run_migration(migrated, issued(), dry_run=False, target_root=root, snapshot_id=2)
    again = {r.path: r.content for r in tables.snapshot_files(spark, root, 2).collect()}
    assert again == written  # a second run changes nothing more
    assert [tuple(r) for r in second.manifest.collect()] == [(1, 2, 1)]
    every = tables.read_snapshots(spark, root)
    restored = snapshots.rollback_full(every, second.manifest)
    assert {r.path: r.content for r in restored.collect()} == written
    used = snapshots.consume_backup(second.manifest, restored)
    assert snapshots.rollback_full(every, used).count() == 0

    summary = tables.read_report(spark, report, "project").first()
    assert summary.project_info.name == "demo"
    assert summary.transformation_summary.completed_operations == 4
    proofs = tables.scan_report(tables.read_report(spark, report, "operations")).collect()
    assert len([p for p in proofs if p.rule_name]) == 3
    assert len([p for p in proofs if p.rule_name is None]) == 2
    names = {r.name for r in tables.read_report(spark, report, "api_entities").collect()}
    assert names == {"f", "C.__init__", "C.send", "add", "g"}
    raw = [
        json.loads(line) for part in (tmp_path / "report" / "operations").glob("*.json")
        for line in part.read_text().splitlines()
    ]
    assert any(op["proof_certificate"] is None for op in raw)


def test_rollback_strategies(spark, files):
    every = files({"a.py": "1", "b.py": "2"}).unionByName(
        files({"a.py": "10", "b.py": "20", "c.py": "30"}, snapshot_id=2)
    )
    manifest = spark.createDataFrame(
        [(1, 1, None), (1, 2, 1)], "project_id BIGINT, snapshot_id INT, backup_snapshot_id INT"
    )
    operations = spark.createDataFrame(
        [(1, "a.py", "completed"), (1, "c.py", "failed")],
        "project_id BIGINT, path STRING, status STRING",
    )

    def after(strategy, snapshot_id=2):
        rows = snapshots.rollback(strategy, every, snapshot_id, manifest, operations).collect()
        return {r.path: r.content for r in rows}

    assert after("full_rollback") == {"a.py": "1", "b.py": "2"}
    assert after("full_rollback", 1) == {}
    assert after("partial_rollback") == {"a.py": "10", "b.py": "20"}
    assert after("manual_verification") == after("selective_rollback") == {
        "a.py": "10", "b.py": "20", "c.py": "30"
    }
    with pytest.raises(ValueError):
        after("other")


def test_rerun_of_a_snapshot_does_not_duplicate(spark, files, tmp_path):
    root = str(tmp_path / "out")
    for _ in range(2):
        run_migration(files(CODE), issued(), dry_run=False, target_root=root, snapshot_id=1)
    assert tables.snapshot_files(spark, root, 1).count() == 4


def test_failed_rows_are_marked(spark, files, tmp_path):
    root = str(tmp_path / "out")

    planned = plan_operations(files(CODE), RuleBook(), issued())
    broken = planned.withColumn(
        "rewritten", F.when(F.col("path") != "api.py", F.col("rewritten"))
    )
    executed = tables.write_snapshot(broken, root, 1)
    summary = report_summary(executed).first()
    assert (summary.completed_operations, summary.failed_operations) == (3, 1)
    target = tables.read_snapshots(spark, root)
    kept = snapshots.rollback_partial(target, executed)
    assert {r.path for r in kept.collect()} == set(CODE) - {"api.py"}


def test_unknown_project_is_an_error(files):
    assert select_project(files(CODE), 1).count() == 4
    with pytest.raises(ValueError):
        select_project(files(CODE), 2)


def edges(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], "src STRING, dst STRING")


def levels(spark, text):
    return {r.v: r.level for r in graph.topological_order(edges(spark, text)).collect()}


def test_graphs_of_many_vertices_are_dealt(spark, monkeypatch):
    from textmason import session

    path = [(k, k + 1) for k in range(20)] + [(0, 9), (3, 15)]
    table = spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in path], "src STRING, dst STRING")
    apart = sorted(graph.topological_order(table).collect())
    monkeypatch.setattr(session, "SENT_ROWS", 0)
    stored = session.cut_lineage(table)
    joined = table.join(session.dealt(stored).select("src"), "src")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(graph.topological_order(table).collect()) == apart
    back = spark.createDataFrame([("20", "00")], "src STRING, dst STRING")
    assert graph.has_cycle(table.union(back)) and not graph.has_cycle(table)


def test_topological_levels(spark):
    assert levels(spark, "AB BC AC AB") == {"A": 0, "B": 1, "C": 2}
    assert levels(spark, "AB AC BD CD XD") == {"A": 0, "X": 0, "B": 1, "C": 1, "D": 2}
    isolated = spark.createDataFrame([("Z",), ("A",)], "v STRING")
    rows = graph.topological_order(edges(spark, "AB"), isolated).collect()
    assert {r.v: r.level for r in rows} == {"A": 0, "Z": 0, "B": 1}


def test_cycles(spark):
    assert graph.has_cycle(edges(spark, "AB BA"))
    assert graph.has_cycle(edges(spark, "AA"))
    assert graph.has_cycle(edges(spark, "XA AB BC CA"))
    assert not graph.has_cycle(edges(spark, "AB AC"))
    with pytest.raises(graph.CycleError):
        graph.topological_order(edges(spark, "AB BC CB"))


def test_neighbours(spark):
    graph_edges = edges(spark, "AB AC DB AB")
    dependencies = lambda v: {r.dependency for r in graph.graph_dependencies(graph_edges, v).collect()}
    assert dependencies("A") == {"B", "C"}
    assert dependencies("B") == dependencies("missing") == set()
    assert {r.dependent for r in graph.graph_dependents(graph_edges, "B").collect()} == {"A", "D"}
    vertices, kept = graph.graph_build(graph_edges)
    assert vertices.count() == 4 and kept.count() == 3


def test_long_chains_are_contracted(spark, monkeypatch):
    n = 20_000
    path = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    levels = graph.topological_order(path)
    found = levels.agg(F.count("*"), F.sum("level"), F.count_if(F.col("v") == F.col("level"))).first()
    assert tuple(found) == (n + 1, n * (n + 1) // 2, n + 1) and len(rounds) < 40
    closed = path.union(spark.createDataFrame([(n, 0)], path.schema))
    assert graph.has_cycle(closed) and not graph.has_cycle(path)
    with pytest.raises(graph.CycleError):
        graph.topological_order(closed)


def longest_paths(edges):
    ends = {x for edge in edges for x in edge}
    levels = {}

    def level(v, seen=()):
        if v in seen:
            raise graph.CycleError
        if v not in levels:
            levels[v] = max((1 + level(a, (*seen, v)) for a, b in edges if b == v), default=0)
        return levels[v]

    return {v: level(v) for v in ends}


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(8, 26)))
             if seed == 5 or a < b}
    frame = spark.createDataFrame(sorted(edges), "src INT, dst INT")
    try:
        wanted = longest_paths(edges)
    except graph.CycleError:
        wanted = None
    assert graph.has_cycle(frame) == (wanted is None)
    if wanted is not None:
        assert {r.v: r.level for r in graph.topological_order(frame).collect()} == wanted


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    parent = {x: x for edge in edges if edge[0] != edge[1] for x in edge}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    frame = spark.createDataFrame(edges, "u INT, v INT")
    found = graph.connected_components(frame).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in parent} and len(found) == len(parent)
    assert graph.connected_components(frame.limit(0)).count() == 0


def test_a_run_goes_on_after_its_last_whole_stage(spark, files, tmp_path, monkeypatch):
    from textmason.plans import migration

    code = files({"a.py": "import requests\ndef f(a): return requests.get(a, timeout=30)\n", "b.py": "def g(): pass\n"})
    issued = F.lit("2024-01-01").cast("timestamp")
    ledger = str(tmp_path / "ledger")
    plain = run_migration(code, issued)

    def fail(*_):
        raise RuntimeError("the driver died")

    with monkeypatch.context() as broken:
        broken.setattr(migration, "project_analysis", fail)
        with pytest.raises(RuntimeError):
            run_migration(code, issued, ledger=ledger)
    parsed = []
    extract = migration.extract_entities
    monkeypatch.setattr(migration, "extract_entities", lambda *a: parsed.append(1) or extract(*a))
    run = run_migration(code, issued, ledger=ledger)
    assert not parsed
    for name in ("entities", "analysis", "operations", "summary"):
        rows = [sorted(map(str, getattr(r, name).collect())) for r in (plain, run)]
        assert rows[0] == rows[1]
    run_migration(code, issued, RuleBook(), ledger=ledger)
    assert not parsed  # the same catalogue, given by name
    changed = run_migration(code.filter("path = 'a.py'"), issued, ledger=ledger)
    assert parsed and changed.entities.count() == 1


def test_a_half_written_stage_is_replaced(spark, tmp_path):
    from textmason.session import Ledger, fingerprint

    ledger = Ledger(spark, str(tmp_path))
    rows = spark.range(5).selectExpr("id", "concat('t', id) AS t")
    assert fingerprint(rows, 1) == fingerprint(rows.orderBy(F.desc("id")).repartition(3), 1)
    assert len({fingerprint(rows, 1), fingerprint(rows, 2), fingerprint(rows.union(rows), 1), fingerprint(rows.limit(0))}) == 4
    ledger.stage("s", "k", lambda: rows)
    (tmp_path / "s-k" / "_SUCCESS").unlink()
    assert ledger.stage("s", "k", lambda: rows.limit(2)).count() == 2
    assert ledger.stage("s", "k", lambda: rows).count() == 2


def snapshot_rows(spark, texts, project_id=1):
    rows = [(project_id, path, text, "completed") for path, text in texts.items()]
    named = spark.createDataFrame(
        rows, "project_id BIGINT, path STRING, content STRING, status STRING"
    )
    return tables.snapshot_rows(named)


def contents(rows):
    return {(r.project_id, r.path): r.content for r in rows.collect()}


def test_a_write_that_fails_midway_leaves_the_old_snapshot(spark, tmp_path):
    root = str(tmp_path / "out")
    assert tables.read_snapshots(spark, root).count() == 0  # nothing is published yet
    tables.publish_snapshot(snapshot_rows(spark, {"a.py": "old"}), root, 1)
    before = tables.read_snapshots(spark, root)
    broken = snapshot_rows(spark, {f"{k}.py": str(k) for k in range(200)}).repartition(20).withColumn(
        "content", F.when(F.col("path") == "77.py", F.raise_error(F.lit("lost"))).otherwise(F.col("content"))
    )
    with pytest.raises(Exception, match="lost"):
        tables.publish_snapshot(broken, root, 1)
    assert contents(tables.read_snapshots(spark, root)) == {(1, "a.py"): "old"}

    # rows that are whole, but that no manifest lists, aren't read either
    snapshot_rows(spark, {"x.py": "unlisted"}).drop("snapshot_id").write.parquet(
        f"{root}/snapshot_id=1/write=wlost"
    )
    assert contents(tables.read_snapshots(spark, root)) == {(1, "a.py"): "old"}
    tables.publish_snapshot(snapshot_rows(spark, {"b.py": "new"}), root, 1)
    assert contents(before) == {(1, "a.py"): "old"}  # a reader goes on with what it began with
    assert contents(tables.read_snapshots(spark, root)) == {(1, "b.py"): "new"}
    assert tables.delete_unlisted(spark, root) >= 2
    assert contents(tables.read_snapshots(spark, root)) == {(1, "b.py"): "new"}
    assert tables.delete_unlisted(spark, root) == 0


def test_a_snapshot_without_rows_replaces_one_with_rows(spark, tmp_path):
    root = str(tmp_path / "out")
    for texts in ({"a.py": "1"}, {}):
        tables.publish_snapshot(snapshot_rows(spark, texts), root, 5)
    assert tables.read_snapshots(spark, root, 5).count() == 0
    assert tables.read_snapshots(spark, root, 6).count() == 0
    assert tables.written_projects(spark, root).count() == 0


def test_restored_backups_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    tables.publish_snapshot(snapshot_rows(spark, {"a.py": "1", "b.py": "2"}), root, 1)
    later = snapshot_rows(spark, {"a.py": "10"}).unionByName(snapshot_rows(spark, {"z.py": "z"}, 2))
    tables.publish_snapshot(later, root, 2)
    left = tables.restore_backup(spark, root, 2)
    # project 2 had no snapshot before, so it becomes empty
    assert contents(tables.read_snapshots(spark, root, 2)) == {(1, "a.py"): "1", (1, "b.py"): "2"}
    assert contents(tables.read_snapshots(spark, root, 1)) == {(1, "a.py"): "1", (1, "b.py"): "2"}
    assert sorted((r.project_id, r.backup_snapshot_id) for r in left.collect()) == [(1, None), (2, None)]


def test_parts_of_a_listing_hold_every_file_once(spark, source, monkeypatch):
    schema = spark.createDataFrame([], listing.LISTING).schema
    wanted = {r.path for r in tree.scan_corpus(spark, str(source), code_only=False).collect()}
    for k in range(40):
        (source / "flat" / f"{k}.py").parent.mkdir(exist_ok=True)
        (source / "flat" / f"{k}.py").write_text("x" * k)
        wanted.add(f"flat/{k}.py")
    # listed whole; cut inside the flat folder; cut before anything is known
    for limit in (100_000, 20, 0):
        monkeypatch.setattr(listing, "LISTED", limit)
        reader = listing.TreeReader({"path": str(source), "tasks": "4"}, schema)
        parts = reader.partitions()
        rows = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
        assert sorted(r["path"] for r in rows) == sorted(wanted)
        assert len(parts) >= 4
        assert {r["path"]: r["size"] for r in rows}["flat/39.py"] == 39
    code = listing.TreeReader({"path": f"{source}/", "tasks": "4", "suffixes": ".py,.js"}, schema)
    rows = [r["path"] for part in code.partitions() for b in code.read(part) for r in b.to_pylist()]
    assert sorted(rows) == sorted(p for p in wanted if p.endswith((".py", ".js")))


def test_files_are_opened_only_for_their_text(spark, source, monkeypatch):
    opened = []
    monkeypatch.setattr(listing, "read_text", lambda uri: (opened.append(uri), ("text", None))[1])

    def rows(columns, **options):
        reader = listing.TreeReader(
            {"path": str(source), **options}, spark.createDataFrame([], columns).schema
        )
        return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    assert len(rows(listing.LISTING)) == 8 and not opened
    assert len(rows(listing.TEXTS, suffixes=".js")) == 1 and len(opened) == 1


def test_a_scan_lists_when_it_is_first_used(spark, tmp_path):
    root = tmp_path / "later"
    assert tree.scan_corpus(spark, str(root)).count() == 0
    scan = tree.scan_corpus(spark, str(root))
    root.mkdir()
    (root / "__init__.py").write_text("a\r\n")
    assert [(r.path, r.content) for r in scan.collect()] == [("__init__.py", "a\n")]


def test_stored_tables_leave_the_session_as_it_was(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP)
    stored = cut_lineage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert stored.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP) == before
    with pytest.raises(Exception, match="lost"):
        cut_lineage(spark.range(3).select(F.raise_error(F.lit("lost")).alias("x")))
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
    forget(stored)


def test_a_task_fills_files_in_a_folder_of_its_own(spark, tmp_path, monkeypatch):
    """tasks that write into one folder of a tree do not make their unfinished files there."""
    from textmason.sources import files as written

    made, put = [], written._put
    monkeypatch.setattr(written, "_put", lambda fs, plain, fill, parts=None: made.append(parts) or put(fs, plain, fill, parts))
    root = str(tmp_path / "tree")
    with written._own_folder(root) as parts:
        written._write_file(root, "src/a.py", "x = 1", parts)
        written._write_file(root, "src/a.py", "x = 2", parts)
        assert made == [parts] * 2 and parts.startswith(f"{root}/.") and list((tmp_path / "tree" / "src").iterdir())
    rows = spark.createDataFrame([(1, "src/b.py", "y = 1"), (1, "c.py", None)], "project_id INT, path STRING, content STRING")
    outcome = {r.path: r.status for r in written.write_tree(rows, root).collect()}
    assert outcome == {"src/b.py": "completed", "c.py": "failed"}
    assert {str(f.relative_to(root)): f.read_text() for f in (tmp_path / "tree").rglob("*") if f.is_file()} == {
        "src/a.py": "x = 2", "src/b.py": "y = 1"}
    assert [f.name for f in (tmp_path / "tree").iterdir()] == ["src"]


def test_an_executed_run_stores_a_gzip_report_if_asked(spark, files, tmp_path):
    """the plain report was most of what a run left on disk; its rows are the same in gzip files."""
    rows = files({"a.py": "import requests\ndef f(u):\n    return requests.get(u, timeout=5)\n", "b.py": "x = 1\n"})
    projects = rows.select("project_id").distinct().select(
        "project_id", F.lit("p").alias("name"), F.lit("s").alias("source_path"), F.lit("t").alias("target_path"),
        F.current_timestamp().alias("created_at"), F.lit("done").alias("status"), F.current_timestamp().alias("completed_at"),
    )
    found = {}
    for how in ("none", "gzip"):
        report = str(tmp_path / how)
        run_migration(
            rows, F.lit("2024-01-01 00:00:00").cast("timestamp"), dry_run=False, target_root=str(tmp_path / f"out_{how}"),
            report_path=report, projects=projects, report_compression=how,
        )
        for section in ("operations", "api_entities"):
            found[how, section] = sorted(map(str, tables.read_report(spark, report, section).collect()))
        names = [f.name for f in (tmp_path / how / "operations").iterdir() if f.name.startswith("part-")]
        assert names and all(name.endswith(".gz") == (how == "gzip") for name in names)
    for section in ("operations", "api_entities"):
        assert found["gzip", section] == found["none", section] != []
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"
