from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from keelson.operators.tables import Tables  # noqa: E402
from keelson.session import configure  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("keelson-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()


REPOS = "repo_full_name string, description string, stars int, forks int, language string, license_name string, fetched_at timestamp"
ISSUES = "repo_full_name string, issue_number bigint, state string, author string, title string, created_at timestamp, updated_at timestamp, closed_at timestamp"
PRS = "repo_full_name string, pr_number bigint, state string, author string, title string, draft boolean, created_at timestamp, updated_at timestamp, closed_at timestamp, merged_at timestamp"
COMMENTS = "repo_full_name string, issue_number bigint, comment_id bigint, author string, created_at timestamp"
REVIEWS = "repo_full_name string, pr_number bigint, review_id bigint, author string, submitted_at timestamp"
COMMITS = "repo_full_name string, sha string, author string, committed_at timestamp"
RELEASES = "repo_full_name string, release_id bigint, draft boolean, created_at timestamp, published_at timestamp"
RUNS = "run_id string, repo_full_name string, started_at timestamp, finished_at timestamp, status string, error_message string"
PAGES = "repo_full_name string, entity_type string, run_day date, page_seq bigint, items int, fetched_at timestamp, limit_hit boolean"

NOW = datetime(2026, 6, 1, 12, 0, 0)


def ago(days: float = 0, hours: float = 0) -> datetime:
    return NOW - timedelta(days=days, hours=hours)


def make_tables(spark, repos=("owner/repo",), issues=(), prs=(), comments=(), reviews=(),
                commits=(), releases=(), runs=(), pages=()) -> Tables:
    repo_rows = [
        (r, None, 10, 1, "Python", "MIT", NOW) if isinstance(r, str) else r for r in repos
    ]
    return Tables(
        repositories=spark.createDataFrame(repo_rows, REPOS),
        issues=spark.createDataFrame(list(issues), ISSUES),
        pull_requests=spark.createDataFrame(list(prs), PRS),
        commits=spark.createDataFrame(list(commits), COMMITS),
        releases=spark.createDataFrame(list(releases), RELEASES),
        issue_comments=spark.createDataFrame(list(comments), COMMENTS),
        pr_reviews=spark.createDataFrame(list(reviews), REVIEWS),
        pipeline_runs=spark.createDataFrame(list(runs), RUNS),
        page_log=spark.createDataFrame(list(pages), PAGES),
    )


def issue(n, created, author="alice", state="open", closed=None, repo="owner/repo"):
    return (repo, n, state, author, f"issue {n}", created, closed or created, closed)


def pr(n, created, author="alice", state="open", draft=False, closed=None, merged=None, repo="owner/repo"):
    return (repo, n, state, author, f"pr {n}", draft, created, closed or created, closed, merged)


def rows(df, key="repo_full_name"):
    return {r[key]: r.asDict() for r in df.collect()}
