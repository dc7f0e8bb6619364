"""Edge cases of the reference's metric tests, ported to tiny DataFrames."""

from __future__ import annotations

from datetime import datetime, timedelta

from keelson.functions.time import Window
from keelson.operators import kpis, tasks

from .conftest import NOW, ago, issue, make_tables, pr, rows

ALL = Window.all()


def test_self_reply_is_ignored(spark):
    t = make_tables(
        spark,
        issues=[issue(1, ago(10), author="alice")],
        comments=[
            ("owner/repo", 1, 1, "alice", ago(10) + timedelta(hours=1)),
            ("owner/repo", 1, 2, "bob", ago(10) + timedelta(hours=5)),
        ],
    )
    r = rows(kpis.issue_response_kpis(t, ALL))["owner/repo"]
    assert r["responded_issues"] == 1
    assert r["median_first_response_hours"] == 5.0
    assert r["no_response"] == 0


def test_bots_are_ignored(spark):
    c = ago(10)
    t = make_tables(
        spark,
        issues=[issue(1, c)],
        comments=[
            ("owner/repo", 1, 1, "dependabot", c + timedelta(hours=1)),
            ("owner/repo", 1, 2, "renovate[bot]", c + timedelta(hours=2)),
            ("owner/repo", 1, 3, "codecov", c + timedelta(hours=3)),
            ("owner/repo", 1, 4, "carol", c + timedelta(hours=24)),
        ],
    )
    r = rows(kpis.issue_response_kpis(t, ALL))["owner/repo"]
    assert (r["responded_issues"], r["no_response"], r["median_first_response_hours"]) == (1, 0, 24.0)


def test_no_response_is_counted_apart(spark):
    t = make_tables(spark, issues=[issue(1, ago(3))])
    r = rows(kpis.issue_response_kpis(t, ALL))["owner/repo"]
    assert r["responded_issues"] == 0
    assert r["median_first_response_hours"] is None
    assert (r["total_issues"], r["no_response"]) == (1, 1)


def test_first_review_excludes_author_and_bots(spark):
    c = ago(5)
    t = make_tables(
        spark,
        prs=[pr(7, c, author="alice")],
        reviews=[
            ("owner/repo", 7, 1, "alice", c + timedelta(hours=4)),
            ("owner/repo", 7, 2, "github-actions[bot]", c + timedelta(hours=5)),
            ("owner/repo", 7, 3, "bob", c + timedelta(hours=14)),
        ],
    )
    r = rows(kpis.pr_response_kpis(t, ALL))["owner/repo"]
    assert (r["reviewed_prs"], r["median_first_review_hours"], r["no_review"]) == (1, 14.0, 0)


def test_window_scopes_issue_population(spark):
    t = make_tables(spark, issues=[issue(1, ago(400)), issue(2, ago(10)), issue(3, ago(5))])
    assert rows(kpis.issue_kpis(t, ALL, NOW))["owner/repo"]["total"] == 3
    w30 = Window.trailing(30, NOW)
    r = rows(kpis.issue_kpis(t, w30, NOW))["owner/repo"]
    assert r["total"] == 2
    assert rows(kpis.issue_kpis(t, ALL, NOW))["owner/repo"]["stale_open"] == 1


def test_monthly_activity_respects_window(spark):
    t = make_tables(spark, issues=[issue(1, ago(400)), issue(2, ago(20))])
    assert kpis.monthly_activity(t, ALL).count() >= 2
    assert kpis.monthly_activity(t, Window.trailing(90, NOW)).count() == 1


def test_backlog_half_even_percentage(spark):
    t = make_tables(
        spark, issues=[issue(1, ago(200)), issue(2, ago(100)), issue(3, ago(10)), issue(4, ago(5))]
    )
    r = rows(kpis.backlog_kpis(t, ALL, NOW))["owner/repo"]
    assert (r["open_issues"], r["issue_stale_90"], r["issue_backlog_90_pct"]) == (4, 2, 50.0)
    assert r["pr_backlog_90_pct"] is None and r["open_prs"] == 0


def test_rounding_modes_differ_on_ties(spark):
    # 1 of 16 = 6.25: backlog rounds half-to-even (6.2), rates half-away (6.3)
    iss = [issue(1, ago(200))] + [issue(i, ago(5)) for i in range(2, 17)]
    closed = [issue(1, ago(200), state="closed", closed=ago(199))] + [
        issue(i, ago(5)) for i in range(2, 17)
    ]
    b = rows(kpis.backlog_kpis(make_tables(spark, issues=iss), ALL, NOW))["owner/repo"]
    assert b["issue_backlog_90_pct"] == 6.2
    k = rows(kpis.issue_kpis(make_tables(spark, issues=closed), ALL, NOW))["owner/repo"]
    assert k["close_rate"] == 6.3


def test_same_number_in_two_repositories(spark):
    c = ago(10)
    t = make_tables(
        spark,
        repos=("a/x", "b/y"),
        issues=[issue(1, c, repo="a/x"), issue(1, c, repo="b/y")],
        comments=[("a/x", 1, 1, "bob", c + timedelta(hours=2))],
    )
    r = rows(kpis.issue_response_kpis(t, ALL))
    assert r["a/x"]["responded_issues"] == 1 and r["b/y"]["responded_issues"] == 0
    assert kpis.comparison_kpis(t, ALL, NOW).count() == 2
    ordered = kpis.comparison_kpis(t, ALL, NOW, ["b/y", "a/x", "zz/none"]).orderBy("position").collect()
    assert [x["repository"] for x in ordered] == ["b/y", "a/x", "zz/none"]
    assert ordered[2]["stars"] is None


def test_empty_repository_gets_a_row(spark):
    t = make_tables(spark, repos=("a/x", "empty/repo"), issues=[issue(1, ago(3), repo="a/x")])
    r = rows(kpis.issue_kpis(t, ALL, NOW))["empty/repo"]
    assert (r["total"], r["open"], r["close_rate"], r["median_close_hours"]) == (0, 0, None, None)
    c = rows(kpis.contributor_kpis(t, ALL, NOW))["empty/repo"]
    assert (c["contributors"], c["active_90d"], c["top_contributor_share"]) == (0, 0, 0.0)


def test_null_authors_never_respond_or_count(spark):
    c = ago(10)
    t = make_tables(
        spark,
        issues=[issue(1, c, author=None), issue(2, c, author="alice")],
        comments=[
            ("owner/repo", 1, 1, "bob", c + timedelta(hours=1)),
            ("owner/repo", 2, 2, None, c + timedelta(hours=1)),
        ],
        prs=[pr(5, c, author=None)],
        commits=[("owner/repo", "s1", None, c)],
    )
    r = rows(kpis.issue_response_kpis(t, ALL))["owner/repo"]
    assert (r["responded_issues"], r["no_response"]) == (0, 2)
    assert rows(kpis.contributor_kpis(t, ALL, NOW))["owner/repo"]["contributors"] == 0


def test_merged_draft_can_push_merge_rate_over_100(spark):
    t = make_tables(
        spark,
        prs=[
            pr(1, ago(9), state="closed", closed=ago(8), merged=ago(8)),
            pr(2, ago(9), state="closed", draft=True, closed=ago(8), merged=ago(8)),
        ],
    )
    assert rows(kpis.pr_kpis(t, ALL))["owner/repo"]["merge_rate"] == 200.0


def test_minute_boundaries_are_counted(spark):
    created = datetime(2026, 1, 1, 10, 0, 59)
    t = make_tables(
        spark,
        issues=[issue(1, created, state="closed", closed=datetime(2026, 1, 1, 10, 1, 1))],
    )
    assert rows(kpis.issue_kpis(t, ALL, NOW))["owner/repo"]["median_close_hours"] == round(1 / 60, 1)
    t2 = make_tables(
        spark, issues=[issue(1, created, state="closed", closed=datetime(2026, 1, 1, 13, 0, 1))]
    )
    # 10:00 -> 13:00 is 180 boundaries = 3.0 hours although only 2h59m02s elapsed
    assert rows(kpis.issue_kpis(t2, ALL, NOW))["owner/repo"]["median_close_hours"] == 3.0


def test_top_contributors_and_retention(spark):
    c = [("owner/repo", f"s{i}", "alice", ago(40 + i)) for i in range(3)]
    c += [("owner/repo", "t1", "bob", ago(10))]
    t = make_tables(spark, commits=c, prs=[pr(1, ago(70), author="bob")])
    top = kpis.top_contributors(t, ALL, 1).collect()
    assert len(top) == 1 and top[0]["author"] == "alice" and top[0]["total_activity"] == 3
    ret = kpis.contributor_retention(t, ALL).collect()
    assert all(r["retention_rate"] <= 100.0 for r in ret)
    assert {r["month_number"] for r in ret if r["cohort_size"]} >= {0}


def test_maintainer_task_priorities(spark):
    c = ago(100)
    t = make_tables(
        spark,
        issues=[issue(1, ago(100)), issue(2, ago(40)), issue(3, ago(8)), issue(4, ago(2))],
        comments=[("owner/repo", 2, 1, "bob", ago(39))],
        prs=[pr(9, ago(20)), pr(10, ago(20), draft=True)],
    )
    out = {(r["task_type"], r["item_number"]): r for r in tasks.maintainer_tasks(t, ALL, NOW).collect()}
    assert out[("Issue", 1)]["reason"] == "open_90d_no_response" and out[("Issue", 1)]["priority"] == "high"
    assert out[("Issue", 2)]["reason"] == "open_30d" and out[("Issue", 2)]["priority"] == "medium"
    assert out[("Issue", 3)]["reason"] == "no_response_7d"
    assert ("Issue", 4) not in out and ("PR", 10) not in out
    assert out[("PR", 9)]["reason"] == "awaiting_first_review" and out[("PR", 9)]["priority"] == "high"
    assert out[("Issue", 1)]["url"] == "https://github.com/owner/repo/issues/1"
    assert c < NOW


def test_tasks_do_not_mix_repositories_with_equal_numbers(spark):
    # N20: the responded set must be keyed by (repository, number)
    c = ago(40)
    t = make_tables(
        spark,
        repos=("a/x", "b/y"),
        issues=[issue(1, c, repo="a/x"), issue(1, c, repo="b/y")],
        comments=[("a/x", 1, 1, "bob", c + timedelta(hours=3))],
    )
    out = {r["repo_full_name"]: r for r in tasks.maintainer_tasks(t, ALL, NOW).collect()}
    assert out["a/x"]["reason"] == "open_30d" and out["a/x"]["priority"] == "medium"
    assert out["b/y"]["reason"] == "no_response_7d" and out["b/y"]["priority"] == "high"
    assert out["b/y"]["url"] == "https://github.com/b/y/issues/1"


def test_single_repository_is_a_filter(spark):
    t = make_tables(spark, repos=("a/x", "b/y"), issues=[issue(1, ago(3), repo="a/x")])
    one = kpis.for_repository(kpis.issue_kpis(t, ALL, NOW), "a/x").collect()
    assert len(one) == 1 and one[0]["total"] == 1


def test_only_stored_repositories_get_rows(spark):
    from keelson.operators import kpis

    orphan = [("orphan/r", 1, "open", "a", "t", ago(3), ago(1), None)]
    t = make_tables(spark, issues=orphan)
    assert [r.repo_full_name for r in kpis.overview(t).collect()] == ["owner/repo"]
    assert [r.repo_full_name for r in kpis.issue_kpis(t, Window.all(), NOW).collect()] == ["owner/repo"]


def test_comparison_of_a_list_keeps_order_and_unknown_names(spark):
    from keelson.operators import kpis

    t = make_tables(spark, repos=("a/a", "b/b"))
    rows = kpis.comparison_kpis(t, Window.all(), NOW, ["b/b", "none/none", "a/a"]).orderBy("position").collect()
    assert [r.repository for r in rows] == ["b/b", "none/none", "a/a"]
    assert (rows[1].active_90d, rows[1].top_contributor_share, rows[1].stars) == (0, 0.0, None)
