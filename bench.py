"""Time the headline operators; prints one JSON line.

The derived corpus is stored once ("ingest"), as a real corpus would be; every operator then
reads that table in full and its result is thrown away row by row.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from textmason.checks import inputs as I  # noqa: E402
from textmason.functions.similarity import multiset_jaccard  # noqa: E402
from textmason.operators import (  # noqa: E402
    diff,
    evidence,
    extract,
    graph,
    nodes,
    rename,
    rollups,
    rules,
)
from textmason.operators.rewrite import rewrite_chain  # noqa: E402
from textmason.plans.migration import run_migration  # noqa: E402
from textmason.plans.versions import diff_versions  # noqa: E402
from textmason.session import cut_lineage, local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, build):
        start = time.perf_counter()
        result = build()
        if result is not None:
            result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    stored = {}

    def ingest():
        stored["files"] = cut_lineage(I.corpus(spark, sf_dir))

    timed("ingest", ingest)

    def ingest_versions():
        stored["versions"] = cut_lineage(I.corpus(spark, sf_dir))

    timed("ingest_versions", ingest_versions)
    files = stored["files"]
    first, second = (stored["versions"].filter(f"snapshot_id = {v}") for v in (1, 2))
    old = files.filter("snapshot_id = 1")
    content, book = F.col("content"), rules.RuleBook()

    def pattern_versions():
        return tuple(diff.dedup_last_wins(I.pattern_entities(v)) for v in (first, second))

    def store_entities():
        stored["old"] = cut_lineage(nodes.extract_entities(first))
        stored["new"] = cut_lineage(nodes.extract_entities(second))

    def unmatched():
        sides = (diff.dedup_last_wins(stored[v]) for v in ("old", "new"))
        aligned = cut_lineage(diff.align(*sides))
        return diff.unmatched_old(aligned), diff.unmatched_new(aligned)

    def neighbours():
        documents = I.table(spark, sf_dir, "documents")
        tokens = documents.select(
            F.col("doc_id").alias("id"), F.explode(F.split("text", " ")).alias("token")
        ).groupBy("id", "token").agg(F.count("*").alias("n"))
        pairs = documents.select((F.col("doc_id") - 1).alias("left_id"),
                                 F.col("doc_id").alias("right_id")).filter("left_id >= 0")
        return multiset_jaccard(pairs, tokens)

    def planned(source):
        return evidence.plan_operations(source, book, I.issued_at())

    timed("opportunity_filter", lambda: rollups.opportunities(old))
    timed("rewrite_chain", lambda: files.select("path", rewrite_chain(content).alias("text")))
    timed("match_rules", lambda: rules.match_rules(files, book))
    timed("plan_operations", lambda: planned(old))
    timed("report_summary", lambda: rollups.report_summary(planned(old)))
    timed("js_functions", lambda: extract.js_functions(files.filter(F.endswith("path", F.lit(".js")))))
    timed("py_functions_regex", lambda: extract.py_functions_regex(files))
    timed("extract_api_usage", lambda: extract.extract_api_usage(files, "requests"))
    timed("syntax_nodes", lambda: nodes.syntax_nodes(old))
    timed("extract_entities", store_entities)
    timed("project_analysis", lambda: rollups.project_analysis(first, stored["old"]))
    timed("diff_exact", lambda: diff.diff_exact(diff.align(*pattern_versions())))
    timed("rename_match", lambda: rename.rename_match(*unmatched()))
    timed("diff_versions", lambda: diff_versions(stored["old"], stored["new"]))
    timed("multiset_jaccard", neighbours)
    timed("topological_order", lambda: graph.topological_order(I.part_edges(spark, sf_dir)))
    timed("run_migration", lambda: run_migration(old, I.issued_at()).metrics)

    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline operators",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
