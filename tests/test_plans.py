"""The catalogue as a whole: SQL checks at the smallest scale, streaming twins, and plan shapes."""

import check_oracle
import pytest

import __spark_entry__ as entry
from estatelens.plans.context import tables
from estatelens.sources import adapters as A

QUICK = [
    "graph_edges", "impact_set", "impact_verdicts", "degree_centrality", "file_ratings", "rating_breakdown", "cross_module_edges",
    "upsert_analyses", "violation_patterns", "uncovered_ranges", "rating_deltas", "file_summaries", "merge_nodes", "find_callers",
    "rule_scan", "change_batches", "stream_change_batches", "stream_upsert", "stream_change_detection", "stream_sessions",
    "stream_rating_windows", "low_rating_alerts", "batch_members", "coverage_matches", "changed_file_risk", "closure_sizes",
    "stream_push_verdicts", "stream_late_windows", "load_graph_nodes", "load_graph_edges", "betweenness_sampled", "remediation_plan",
]


@pytest.fixture(scope="module")
def con(sf):
    return check_oracle.connect(sf)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sf, con, name):
    assert check_oracle.compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["graph_edges", "impact_verdicts", "file_summaries", "coverage_violations", "find_callers", "resolve_imports", "fan_out", "ignored_files"])
def test_no_python_and_no_products(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "ArrowEval" not in text


def test_scans_are_pruned(spark, sf):
    text = plan(entry.queries()["violation_priorities"](spark, sf))
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_tables_are_shared_per_folder(spark, sf):
    assert tables(spark, sf) is tables(spark, sf)


@pytest.mark.parametrize("name", ["global_worst_nodes", "index_repo_nodes", "filtered_graph_nodes"])
def test_queries_of_nodes_build_no_edges(spark, sf, con, monkeypatch, name):
    def edges(*_):
        raise AssertionError("edges were built")

    monkeypatch.setattr(A, "edges", edges)
    fresh = f"{sf}/."  # tables of its own
    assert check_oracle.compare(entry.queries()[name](spark, fresh), con, entry.oracle_sql()[name]) is None
