"""How much the queries move and hold, on rows built here."""

import datetime
import os

from pyspark.sql import functions as F

from textmason.checks import inputs as I
from textmason import session
from textmason.checks import joins, rollups, scans
from textmason.functions.similarity import multiset_jaccard
from textmason.operators import diff, extract
from textmason.sources import files as tree
from textmason.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df):
    return [line for line in _plan(df).splitlines() if "Exchange hashpartitioning" in line]


def _line_items(spark, folder):
    """Orders 1 to 40 of three items each, and one order whose items all leave version 2."""
    items = [(o, 10 * o + n, o % 5, n, 5.0 * n) for o in range(1, 41) for n in (1, 2, 3)]
    items += [(41, 11, 1, 1, 3.0), (None, 1, 1, 1, 1.0), (42, None, 2, 1, 4.0)]
    schema = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE"
    spark.createDataFrame(items, schema).write.parquet(f"{folder}/lineitem.parquet")
    orders = [(o, o % 7) for o in range(1, 43)] + [(3, 4), (None, 1)]
    spark.createDataFrame(orders, "o_orderkey BIGINT, o_custkey BIGINT").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_multiset_jaccard_deals_no_tokens_by_pair(spark):
    tokens = spark.createDataFrame(
        [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, None, 1), (3, "a", 1), (3, "a", 1), (3, "b", 1), (None, "a", 1)],
        "id BIGINT, token STRING, n BIGINT",
    )
    pairs = spark.createDataFrame(
        [(1, 2), (1, 2), (1, 3), (2, 9), (8, 9), (None, 1), (1, None)], "left_id BIGINT, right_id BIGINT"
    )
    found = multiset_jaccard(pairs, tokens)
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    assert rows == sorted(
        [(1, 2, 0.25), (1, 2, 0.25), (1, 3, 1.0), (2, 9, 0.0), (8, 9, 1.0), (None, 1, 1.0), (1, None, 1.0)], key=str
    )
    dealt = tokens.filter("id IS NOT NULL").repartition(3, "id")
    assert not [line for line in _exchanges(multiset_jaccard(pairs, dealt)) if "token" in line.split("(")[1]]


def test_multiset_jaccard_query_deals_texts_once(spark, tmp_path):
    rows = [(1, "a b a"), (2, "a b"), (3, None), (5, ""), (2, "c"), (None, "a")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    found = rollups.multiset_jaccard(spark, str(tmp_path))
    # of the documents of one id the tokens add up, and each of them makes a pair
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 0.5), (1, 2, 0.5), (2, 3, 0.0), (2, 3, 0.0)]
    assert not [line for line in _exchanges(found) if "token" in line.split("(")[1]]


def test_report_sections_are_compressed(spark, tmp_path):
    operations = spark.createDataFrame(
        [(1, "a.py", "x", "pending")], "project_id BIGINT, path STRING, op_id STRING, status STRING"
    ).withColumns({
        "changes": F.array().cast(tables.CHANGES), "certificate": F.lit(None).cast(tables.CERTIFICATE),
    })
    at = datetime.datetime(2024, 1, 1)
    projects = spark.createDataFrame(
        [(1, "p", "s", "t", at, "done", at)],
        "project_id BIGINT, name STRING, source_path STRING, target_path STRING, created_at TIMESTAMP,"
        " status STRING, completed_at TIMESTAMP",
    )
    summary = spark.createDataFrame(
        [(1, 1, 0, 0, 0.0, 0.0)],
        "project_id BIGINT, total_operations BIGINT, completed_operations BIGINT, failed_operations BIGINT,"
        " total_confidence DOUBLE, average_confidence DOUBLE",
    )
    entities = extract.functions_by_pattern(spark.createDataFrame(
        [(1, 1, "a.py", "def f(a):")], "project_id BIGINT, snapshot_id INT, path STRING, content STRING"
    ))
    path = tables.write_report(f"{tmp_path}/r", projects, summary, operations, entities, compression="gzip")
    for section in tables.SECTIONS:
        parts = [name for name in os.listdir(f"{path}/{section}") if name.startswith("part-")]
        assert parts and all(name.endswith(".json.gz") for name in parts)
        assert tables.read_report(spark, path, section).count() == 1


def test_a_worker_holds_few_texts(spark, tmp_path):
    import pyarrow as pa

    uris = []
    for k in range(4):
        (tmp_path / f"{k}.txt").write_text("x" * (3 << 20))
        uris.append(f"{tmp_path}/{k}.txt")
    batch = pa.RecordBatch.from_arrays([pa.array(uris), pa.array(uris)], names=["uri", "path"])
    assert [out.num_rows for out in tree._read_files([batch])] == [2, 2]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.createDataFrame([(1, "a/b.txt", "t"), (1, "n.txt", None)], "project_id BIGINT, path STRING, content STRING")
    done = tree.write_tree(rows, f"{tmp_path}/out")
    assert sorted(r["status"] for r in done.collect()) == ["completed", "failed"]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_functions_by_pattern_is_both_extractors(spark, files):
    texts = {
        "a.js": "async function f(a, b = 1) {}\nfunction f(c) {}\nconst g = (x) => x\nlet h = async y => y\nfunction k( q ) {}",
        "b.js": "def no(a):", "c.py": "def f(self, a, b=1):\n  pass\ndef f(c):\n  pass\ndef g():", "d": "", "e.js": "",
    }
    found = files(texts).unionByName(files({"n.py": None, "n.js": None}))
    js = F.endswith("path", F.lit(".js"))
    apart = extract.js_functions(found.filter(js)).unionByName(extract.py_functions_regex(found.filter(~js)))
    once = extract.functions_by_pattern(found)
    assert once.schema.simpleString() == apart.schema.simpleString()
    rows = lambda df: sorted(df.select(F.to_json(F.struct(*df.columns))).toPandas().iloc[:, 0])
    assert rows(once) == rows(apart) and len(rows(once)) == 7


def test_line_items_are_dealt_as_numbers_to_parts_that_follow_their_count(spark, tmp_path, monkeypatch):
    folder = _line_items(spark, tmp_path)
    plain = sorted(tuple(r) for r in I.corpus(spark, folder).collect())
    assert plain and not [r for r in plain if r[1] == 2 and r[2].endswith("_41.py")]
    exact = lambda: sorted(
        map(str, joins.signature_count_change(spark, folder).collect() + joins.unmatched_old(spark, folder).collect())
    )
    before = exact()
    monkeypatch.setattr(I, "TASK_ITEMS", 10)  # as if the table were large
    assert I.item_parts(spark, folder) == 13
    assert sorted(tuple(r) for r in I.corpus(spark, folder).collect()) == plain
    assert exact() == before
    found = joins.signature_count_change(spark, folder)
    lines = _exchanges(found)
    assert [line for line in lines if "key" in line and ", 13)" in line]
    assert [line for line in lines if "hashpartitioning(l_orderkey" in line and ", 13)" in line]
    assert "snippet" not in "".join(line for line in _plan(found).splitlines() if "partial_collect_list" in line)


def test_a_dealt_inventory_is_the_same(spark, files):
    found = extract.functions_by_pattern(files({"a.py": "def f(a):\ndef f(b):", "b.py": "def g():"}))
    dealt = diff.dedup_last_wins(found, keep=("name", "args"), parts=5)
    whole = diff.dedup_last_wins(found).select(*dealt.columns)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
    assert dealt.columns == ["project_id", "key", "position", "name", "args"]


def _files_below(folder):
    return [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names]


def test_scan_corpus_keeps_one_tree_of_files_at_a_time(spark, tmp_path, monkeypatch):
    folder = _line_items(spark, tmp_path)
    whole = {(r.path, r.content_hash) for r in scans.scan_corpus(spark, folder).collect()}
    roots, counts = [], []
    write, delete = tree.write_tree, tree.delete_tree

    def written(files, root, *more):
        roots.append(root.removeprefix("file:"))
        return write(files, root, *more)

    def deleted(rows, root):
        counts.append(len(_files_below(roots[-1])))
        assert not any(_files_below(r) for r in roots[:-1])
        delete(rows, root)

    monkeypatch.setattr(scans, "TREE_FILES", 10)
    monkeypatch.setattr(tree, "write_tree", written)
    monkeypatch.setattr(tree, "delete_tree", deleted)
    in_trees = [(r.path, r.content_hash) for r in scans.scan_corpus(spark, folder).collect()]
    assert len(in_trees) == len(whole) > 40 and set(in_trees) == whole
    assert len(counts) == 5 and max(counts) < len(whole) // 2
    assert not any(os.path.exists(root) for root in roots)


def _jobs_that(spark, monkeypatch, module):
    """Tables that a module stores."""
    stored, cut = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df, *by: stored.append(df) or cut(df, *by))
    return stored


def test_counts_of_a_project_make_the_code_files_once(spark, tmp_path, monkeypatch):
    folder = _line_items(spark, tmp_path)
    for query in (rollups.project_analysis, rollups.run_metrics):
        with monkeypatch.context() as patched:
            stored = _jobs_that(spark, patched, rollups)
            rows = query(spark, folder)
            assert [set(table.columns) for table in stored] == [
                {"project_id", "snapshot_id", "path", "content"}, {"project_id"}
            ]
            assert "lineitem" not in _plan(rows) and rows.count() == 7


def test_texts_to_parse_are_read_in_several_tasks_a_core(spark, tmp_path):
    key, cores = "spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism
    for k in range(3 * cores):
        spark.range(50_000).selectExpr("sha2(string(id + rand()), 256) AS x").coalesce(1).write.mode("append").parquet(str(tmp_path))
    before = spark.read.parquet(str(tmp_path)).rdd.getNumPartitions()
    with session.fine_tasks(spark):
        assert spark.read.parquet(str(tmp_path)).rdd.getNumPartitions() >= 3 * cores > before
    assert spark.conf.get(key, None) is None
