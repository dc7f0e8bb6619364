"""Physical-plan properties that matter at scale."""

from __future__ import annotations

import __spark_entry__ as E

from .conftest import SF


def plan(spark, name: str) -> str:
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_shuffle(spark):
    p = plan(spark, "top_contributors")
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_window_filter_reaches_the_scan(spark):
    p = plan(spark, "issue_kpis_180d")
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in p


def test_bot_filter_reaches_event_scan(spark):
    p = plan(spark, "issue_response_kpis")
    assert "Not(StringStartsWith(author,dependabot))" in p


def test_windowed_responses_read_only_the_windows_events(spark):
    p = plan(spark, "pr_response_kpis_180d")
    assert "LeftSemi" in p
    events = [line for line in p.splitlines() if "FileScan" in line and "submitted_at" in line]
    assert len(events) == 1
    own = [line for line in p.splitlines() if "FileScan" in line and "created_at" in line]
    assert own and all("GreaterThanOrEqual(created_at" in line for line in own)


def test_distinct_counts_do_not_expand(spark):
    assert "Expand" not in plan(spark, "contributor_kpis")


def test_no_cartesian_products(spark):
    for name in ("report_findings", "coverage", "maintainer_tasks", "comparison_kpis"):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_keep_last_is_a_partial_aggregate(spark):
    p = plan(spark, "upsert_keep_last")
    assert "max_by" in p and "Window" not in p
