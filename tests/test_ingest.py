"""Feeds, normalisation, upserts, cursors, coverage fold and schema evolution."""

from __future__ import annotations

import json
import os
from datetime import date, datetime

from pyspark.sql import functions as F

from keelson.functions.time import parse_timestamp, iso_z
from keelson.operators import coverage as cov
from keelson.operators import incremental as inc
from keelson.operators.upsert import evolve, keep_last, upsert
from keelson.schemas import RUNS, RUNS_DEFAULTS
from keelson.session import scratch_path
from keelson.sources import feeds

from .conftest import make_tables, rows

ISSUE = {
    "number": 1,
    "state": "open",
    "user": {"login": "analyst"},
    "title": "Metric definition",
    "labels": [{"name": "analytics"}, {"name": ""}, {"name": "good first issue"}],
    "comments": 2,
    "locked": False,
    "created_at": "2026-01-01T00:00:00Z",
    "updated_at": "2026-01-02T00:00:00Z",
    "closed_at": None,
}


def feed_of(spark, entity, records, repo="owner/repo", start_seq=0):
    data = [(repo, "run", start_seq + i, json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(data, "repo_full_name string, run_id string, arrival_seq long, payload string")
    return feeds.parse_feed(df, entity)


def test_issue_upsert_is_idempotent_and_sets_cursor(spark):
    batch = feeds.normalise_issues(feed_of(spark, "issues", [ISSUE]))
    once = upsert(None, batch, "issues")
    twice = upsert(once, batch, "issues")
    assert twice.count() == 1
    row = twice.collect()[0]
    assert row["labels_json"] == '["analytics", "good first issue"]'
    assert (row["comments"], row["locked"], row["author"]) == (2, False, "analyst")
    t = make_tables(spark)
    t.issues = twice
    cur = {r["entity_type"]: r for r in inc.cursors(t).collect()}
    assert cur["issues"]["latest"] == datetime(2026, 1, 2)
    assert cur["issues"]["since"] == datetime(2026, 1, 1, 23, 55)


def test_last_arrival_wins_not_newest_update(spark):
    newer = dict(ISSUE, updated_at="2026-03-01T00:00:00Z", state="closed")
    older = dict(ISSUE, updated_at="2026-02-01T00:00:00Z", title="late arrival")
    batch = feeds.normalise_issues(feed_of(spark, "issues", [newer, older]))
    row = upsert(None, batch, "issues").collect()[0]
    assert row["title"] == "late arrival"


def test_pull_requests_are_removed_from_issue_feed(spark):
    recs = [ISSUE, dict(ISSUE, number=2, pull_request={"url": "x"})]
    assert feeds.normalise_issues(feed_of(spark, "issues", recs)).count() == 1


def test_missing_keys_take_defaults(spark):
    rec = {"number": 3, "state": "open", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-01T00:00:00Z"}
    row = feeds.normalise_issues(feed_of(spark, "issues", [rec])).collect()[0]
    assert (row["comments"], row["locked"], row["author"], row["labels_json"]) == (0, False, None, "[]")
    repo = feeds.normalise_repository(
        feed_of(spark, "repository", [{"full_name": "owner/repo", "watchers_count": 4, "license": {"name": "Apache"}}]),
        F.lit("2026-01-01 00:00:00").cast("timestamp"),
    ).collect()[0]
    assert (repo["stars"], repo["forks"], repo["watchers"], repo["license_name"]) == (0, 0, 4, "Apache")


def test_commit_normalisation_and_drop_without_date(spark):
    recs = [
        {"sha": "a", "author": None, "commit": {"message": "m", "author": {"name": "Ann", "date": "2026-01-01T00:00:00Z"}, "committer": {"date": None}}},
        {"sha": "b", "author": {"login": "bob"}, "commit": {"author": {"name": "Bob"}, "committer": {}}},
    ]
    out = feeds.normalise_commits(feed_of(spark, "commits", recs)).collect()
    assert len(out) == 1 and out[0]["author"] == "Ann" and out[0]["committed_at"] == datetime(2026, 1, 1)


def test_comment_numbers_from_urls(spark):
    urls = ["https://api.github.com/repos/o/r/issues/42", "https://x/issues/42/", "https://x/issues/x42", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(feeds.issue_number_from_url("url")).collect()]
    assert got == [42, 42, None, None, None]


def test_repository_ids(spark):
    cases = {
        "duckdb/duckdb": "duckdb/duckdb",
        " owner/repo/ ": "owner/repo",
        "repo": None,
        "a/b/c": None,
        "/repo": None,
        "owner/": None,
        "../repo": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r[0]: r[1] for r in df.select("raw", feeds.repository_id("raw")).collect()}
    assert got == cases


def test_time_parsing_and_formatting(spark):
    df = spark.createDataFrame(
        [("2026-06-15T08:30:00Z",), ("2026-06-15T20:00:00+08:00",), ("Mon, 15 Jun 2026 08:30:00 GMT",), ("junk",), ("",),
         ("2026-06-15T08:30:00",)],
        "s string",
    )
    out = [r[0] for r in df.select(parse_timestamp("s")).collect()]
    assert out[:3] == [datetime(2026, 6, 15, 8, 30), datetime(2026, 6, 15, 12, 0), datetime(2026, 6, 15, 8, 30)]
    assert out[3:5] == [None, None]
    assert out[5] == datetime(2026, 6, 15, 8, 30)  # naive text is taken as UTC
    assert df.select(iso_z(parse_timestamp("s"))).first()[0] == "2026-06-15T08:30:00Z"


def test_keep_last_reduces_hot_key(spark):
    data = [(1, i, f"v{i}") for i in range(1000)] + [(2, 0, "only")]
    df = spark.createDataFrame(data, "k int, seq int, v string")
    got = {r["k"]: r["v"] for r in keep_last(df, ["k"], ["seq"]).collect()}
    assert got == {1: "v999", 2: "only"}


def _pages(days):
    rows = []
    for seq, (day, entity, items, hit) in enumerate(days):
        rows.append(("owner/repo", entity, day, seq, items, datetime.combine(day, datetime.min.time()), hit))
    return rows


def test_truncated_history_stays_incomplete(spark):
    pages = _pages([
        (date(2026, 1, 1), "issues", 100, True),
        (date(2026, 1, 1), "releases", 100, True),
        (date(2026, 1, 2), "issues", 1, False),
        (date(2026, 1, 2), "releases", 3, False),
    ])
    t = make_tables(spark, pages=pages)
    got = {r["entity_type"]: r for r in cov.coverage(t, t.page_log).collect()}
    assert len(got) == 6
    assert got["issues"]["history_complete"] is False
    assert got["issues"]["last_run_truncated"] is False and got["issues"]["pages_fetched"] == 1
    assert got["releases"]["history_complete"] is True  # full replacement recovers
    assert got["pr_reviews"]["coverage_scope"] == "trailing_180_days"
    assert got["commits"]["pages_fetched"] == 0


def test_page_limit_rule(spark):
    df = spark.createDataFrame([(1, 100), (1, 99), (2, 100)], "page int, items int")
    got = [r[0] for r in df.select(cov.page_limit_hit("page", "items", 1)).collect()]
    assert got == [True, False, False]


def test_schema_evolution_keeps_legacy_rows(spark, tmp_path):
    legacy = spark.createDataFrame(
        [("r1", "owner/repo", datetime(2024, 1, 1), datetime(2024, 1, 1), "success", 5, 3, 10, 2, None)],
        "run_id string, repo_full_name string, started_at timestamp, finished_at timestamp, status string, issues_loaded int, pull_requests_loaded int, commits_loaded int, releases_loaded int, error_message string",
    )
    base = scratch_path(spark, f"evolve-{os.getpid()}-{tmp_path.name}")
    legacy.write.mode("overwrite").parquet(os.path.join(base, "layout=legacy"))
    merged = spark.read.option("mergeSchema", True).parquet(base).drop("layout")
    out = evolve(merged, [f.name for f in RUNS.fields], RUNS_DEFAULTS, {f.name: f.dataType for f in RUNS.fields})
    row = out.collect()[0]
    assert row["issues_loaded"] == 5 and row["pr_reviews_loaded"] == 0 and row["is_incremental"] is False
    assert out.columns == [f.name for f in RUNS.fields]


def test_review_scope_union_and_missing_pr(spark):
    from .conftest import ago, pr, NOW

    new = make_tables(spark, prs=[pr(1, ago(10)), pr(2, ago(400))]).pull_requests
    stored = make_tables(spark, prs=[pr(3, ago(20)), pr(1, ago(10))]).pull_requests
    incremental = spark.createDataFrame([("owner/repo", True)], "repo_full_name string, is_incremental boolean")
    scope = inc.review_scope(new, stored, incremental, NOW)
    assert sorted(r["pr_number"] for r in scope.collect()) == [1, 3]
    first_run = spark.createDataFrame([], "repo_full_name string, is_incremental boolean")
    assert sorted(r["pr_number"] for r in inc.review_scope(new, stored, first_run, NOW).collect()) == [1]


def test_collection_result_lists_truncated_entities(spark):
    pages = _pages([
        (date(2026, 1, 1), "issues", 100, True),
        (date(2026, 1, 1), "commits", 100, True),
        (date(2026, 1, 1), "releases", 3, False),
    ])
    t = make_tables(spark, pages=pages)
    r = rows(inc.collection_results(t.page_log))["owner/repo"]
    assert r["truncated_entities"] == "commits,issues"
    assert r["total_loaded"] == 203 and r["pr_reviews_loaded"] == 0


def test_repository_exists_marks_incremental_runs(spark):
    t = make_tables(spark, repos=("a/x",))
    cand = spark.createDataFrame([("a/x",), ("new/repo",)], "repo_full_name string")
    got = {r["repo_full_name"]: r["is_incremental"] for r in inc.repository_exists(t, cand).collect()}
    assert got == {"a/x": True, "new/repo": False}


def test_every_iso_form_parses(spark):
    from datetime import datetime

    from keelson.functions.time import parse_timestamp

    want = datetime(2026, 6, 15, 8, 30)
    texts = {
        "2026-06-15T08:30:00Z": want, "2026-06-15T08:30Z": want, "20260615T083000Z": want, "20260615T0830Z": want,
        "2026-06-15T16:30:00+0800": want, "2026-06-15T16:30:00+08": want, "2026-06-15T16:30+08:00": want,
        "2026-06-15 08:30:00": want, "2026-06-15T08:30": want, "2026-06-15": datetime(2026, 6, 15), "20260615": datetime(2026, 6, 15),
        "2026-06-15T08:30:00.1234567Z": want.replace(microsecond=123456), "2026-06-15T08:30:00,5Z": want.replace(microsecond=500000),
        "2026-06-15T08:30:00.123+00:00": want.replace(microsecond=123000), "2026-06-15T03:30:00-05:00": want,
        "Mon, 15 Jun 2026 08:30:00 GMT": want, "2026-06-15T08Z": want.replace(minute=0), "": None, "soon": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_timestamp("t").cast("timestamp_ntz").alias("ts"))
    assert {r.t: r.ts for r in df.collect()} == texts


def test_releases_missing_from_a_batch_stay(spark):
    from keelson.operators.incremental import replace_releases

    schema = "repo_full_name string, release_id long, tag_name string, arrival_seq long"
    stored = spark.createDataFrame([("o/r", 1, "v1", 1), ("o/r", 2, "v2", 2)], schema)
    batch = spark.createDataFrame([("o/r", 2, "v2b", 3), ("o/r", 3, "v3", 4)], schema)
    got = {r.release_id: r.tag_name for r in replace_releases(stored, batch).collect()}
    assert got == {1: "v1", 2: "v2b", 3: "v3"}
