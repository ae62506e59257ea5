"""Every registered query against its SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import rename_sql
from oracle import compare
from textmason.checks import ORACLES, QUERIES
from textmason.checks import inputs as I
from textmason.operators import diff, rename
from textmason.operators.nodes import extract_entities
from textmason.plans import versions

SF_DIR = "/root/testdata/sf0.001"

#: Whose SQL is too slow for whole projects; see also test_rename.py.
BY_PAIRS = {"rename_candidates", "rename_match", "rename_match_in_rounds", "diff_versions", "name_similarity"}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) | BY_PAIRS


def _unmatched(spark, sf_dir, project):
    aligned = diff.align(*[
        diff.dedup_last_wins(extract_entities(I.corpus(spark, sf_dir, v, project=project)).drop("docstring"))
        for v in (1, 2)
    ])
    return diff.unmatched_old(aligned), diff.unmatched_new(aligned)


def _rounded(rows, column="score"):
    return rows.withColumn(column, F.round(column, 6))


OF_SMALL_PROJECTS = {
    "RENAME_MATCH": lambda s, d: _rounded(rename.rename_match(*_unmatched(s, d, rename_sql.SMALL))),
    "RENAME_CANDIDATES": lambda s, d: _rounded(rename.rename_candidates(*_unmatched(s, d, rename_sql.SMALL))),
    "NAME_SIMILARITY": lambda s, d: _rounded(
        rename.name_similarity(*_unmatched(s, d, rename_sql.SMALL), floor=0.9)),
    "DIFF_VERSIONS": lambda s, d: _rounded(versions.diff_versions(
        *(extract_entities(I.corpus(s, d, v, project=rename_sql.SMALL)) for v in (1, 2))), "confidence"),
}


@pytest.mark.parametrize("name", sorted(OF_SMALL_PROJECTS))
def test_renames_of_small_projects_are_those_of_sql(spark, name):
    rows, problem = compare(spark, SF_DIR, OF_SMALL_PROJECTS[name], getattr(rename_sql, name))
    assert problem is None
    assert rows > 0


def test_both_ways_of_matching_whole_projects_agree(spark):
    in_tasks, by_join = (
        sorted(map(tuple, QUERIES[name](spark, SF_DIR).collect()))
        for name in ("rename_match", "rename_match_in_rounds")
    )
    assert in_tasks == by_join and len(in_tasks) > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    rows, problem = compare(spark, SF_DIR, QUERIES[name], ORACLES[name])
    assert problem is None
    assert rows > 0


def test_entry(spark):
    import importlib

    frame = importlib.import_module("__spark_entry__").entry(spark)
    assert frame.count() == 50
    assert "changed_files" in frame.columns
