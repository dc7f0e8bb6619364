"""Positions of list-shaped outputs, and coverage by run."""

from __future__ import annotations

from datetime import datetime

from keelson.operators import coverage as cov
from keelson.operators.ordering import in_order

from .conftest import ago, issue, make_tables


def test_positions_restart_in_every_repository(spark):
    df = spark.createDataFrame([("b/b", 2), ("a/a", 9), ("b/b", 1), ("b/b", None)], "repo_full_name string, n int")
    got = {(r.repo_full_name, r.n): r.position for r in in_order(df, "n").collect()}
    assert got == {("a/a", 9): 0, ("b/b", None): 0, ("b/b", 1): 1, ("b/b", 2): 2}


def _pages(spark, rows):
    return spark.createDataFrame(
        rows, "repo_full_name string, run_id string, entity_type string, page int, items int, max_pages int, fetched_at timestamp"
    ).withColumn("limit_hit", cov.page_limit_hit("page", "items", "max_pages"))


def test_coverage_by_run_truncation_sticks_and_releases_recover(spark):
    t1, t2 = datetime(2026, 1, 1, 9), datetime(2026, 1, 1, 15)  # two runs on one day
    rows = [("owner/repo", "z-first", e, p, 100, 2, t1) for e in ("issues", "releases") for p in (1, 2)]
    rows += [("owner/repo", "a-second", e, 1, 100, 3, t2) for e in ("issues", "releases")]
    tables = make_tables(spark, issues=[issue(1, ago(3))])
    got = {r.entity_type: r for r in cov.coverage(tables, _pages(spark, rows), run="run_id").collect()}
    assert len(got) == 6
    assert not got["issues"].history_complete and not got["issues"].last_run_truncated
    assert got["releases"].history_complete
    assert got["commits"].history_complete and got["commits"].pages_fetched == 0
    assert {r.last_run_id for r in got.values()} == {"owner/repo@a-second"}  # the run that fetched last
    assert {r.max_pages for r in got.values()} == {3}
    stats = cov.run_stats(_pages(spark, rows), "run_id").collect()
    assert {(r.run_id, r.entity_type, r.pages, r.truncated) for r in stats} == {
        ("z-first", "issues", 2, True), ("z-first", "releases", 2, True),
        ("a-second", "issues", 1, False), ("a-second", "releases", 1, False),
    }
