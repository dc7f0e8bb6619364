"""Explicit schemas: raw landed feed records and the normalised entity tables.

Schemas are never inferred; raw feeds are read with these StructTypes so a
malformed record yields NULL fields instead of a schema drift.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

S, I, L, B, TS = StringType(), IntegerType(), LongType(), BooleanType(), TimestampType()


def struct(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


USER = struct(("login", S))
LABEL = struct(("name", S))
LICENSE = struct(("spdx_id", S), ("name", S))
PERSON = struct(("name", S), ("date", S))

# --- raw feed records (timestamps arrive as ISO-8601 text) ----------------------------------

RAW_REPOSITORY = struct(
    ("full_name", S), ("description", S), ("stargazers_count", L), ("forks_count", L),
    ("subscribers_count", L), ("watchers_count", L), ("open_issues_count", L),
    ("default_branch", S), ("language", S), ("license", LICENSE), ("created_at", S),
    ("updated_at", S), ("pushed_at", S),
)
RAW_ISSUE = struct(
    ("number", L), ("state", S), ("user", USER), ("title", S), ("labels", ArrayType(LABEL)),
    ("comments", I), ("locked", B), ("created_at", S), ("updated_at", S), ("closed_at", S),
    ("pull_request", struct(("url", S))),
)
RAW_PULL = struct(
    ("number", L), ("state", S), ("user", USER), ("title", S), ("draft", B), ("comments", I),
    ("review_comments", I), ("created_at", S), ("updated_at", S), ("closed_at", S),
    ("merged_at", S), ("merge_commit_sha", S),
)
RAW_COMMIT = struct(
    ("sha", S), ("author", USER),
    ("commit", struct(("message", S), ("author", PERSON), ("committer", PERSON))),
)
RAW_RELEASE = struct(
    ("id", L), ("tag_name", S), ("name", S), ("author", USER), ("draft", B), ("prerelease", B),
    ("created_at", S), ("published_at", S),
)
RAW_COMMENT = struct(("id", L), ("issue_url", S), ("user", USER), ("body", S), ("created_at", S))
RAW_REVIEW = struct(
    ("id", L), ("pr_number", L), ("user", USER), ("state", S), ("body", S), ("submitted_at", S)
)

RAW = {
    "repository": RAW_REPOSITORY,
    "issues": RAW_ISSUE,
    "pull_requests": RAW_PULL,
    "commits": RAW_COMMIT,
    "releases": RAW_RELEASE,
    "issue_comments": RAW_COMMENT,
    "pr_reviews": RAW_REVIEW,
}

# Envelope columns every landed record carries next to its payload.
ENVELOPE = struct(("repo_full_name", S), ("run_id", S), ("arrival_seq", L))

# --- natural keys of the entity tables -------------------------------------------------------

KEYS = {
    "repositories": ("repo_full_name",),
    "issues": ("repo_full_name", "issue_number"),
    "pull_requests": ("repo_full_name", "pr_number"),
    "commits": ("repo_full_name", "sha"),
    "releases": ("repo_full_name", "release_id"),
    "issue_comments": ("repo_full_name", "comment_id"),
    "pr_reviews": ("repo_full_name", "review_id"),
    "pipeline_runs": ("run_id",),
    "collection_coverage": ("repo_full_name", "entity_type"),
}

# --- pipeline_runs: the current layout and the legacy layout it evolved from -------------------

RUNS = struct(
    ("run_id", S), ("repo_full_name", S), ("started_at", TS), ("finished_at", TS), ("status", S),
    ("issues_loaded", I), ("pull_requests_loaded", I), ("commits_loaded", I),
    ("releases_loaded", I), ("issue_comments_loaded", I), ("pr_reviews_loaded", I),
    ("max_pages", I), ("is_incremental", B), ("error_message", S),
)
RUNS_LEGACY_COLUMNS = (
    "run_id", "repo_full_name", "started_at", "finished_at", "status", "issues_loaded",
    "pull_requests_loaded", "commits_loaded", "releases_loaded", "error_message",
)
# Defaults for columns added after the legacy layout.
RUNS_DEFAULTS = {
    "issue_comments_loaded": 0,
    "pr_reviews_loaded": 0,
    "max_pages": 0,
    "is_incremental": False,
}
