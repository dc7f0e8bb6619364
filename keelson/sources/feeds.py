"""Landed feed records -> normalised entity rows (SRC1-7, PRJ1-9).

A feed is a DataFrame of raw records (``RAW_*`` schemas) plus the envelope
columns ``repo_full_name``, ``run_id`` and ``arrival_seq``. Landed JSON files
are read with :func:`read_feed` (schema given, never inferred); JSON text
already in a column is parsed with :func:`parse_feed`. Every normaliser is a
single ``select`` of Column expressions, so it runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.functions.time import parse_timestamp
from keelson.schemas import ENVELOPE, RAW

REPO = "repo_full_name"
ENV = [f.name for f in ENVELOPE.fields]


def read_feed(spark: SparkSession, entity: str, path: str) -> DataFrame:
    """Read landed JSON-lines records of one entity with its explicit schema."""
    schema = StructType(ENVELOPE.fields + RAW[entity].fields)
    return spark.read.schema(schema).json(path)


def parse_feed(df: DataFrame, entity: str, json_col: str = "payload") -> DataFrame:
    """Parse a JSON text column into the raw record fields (envelope kept)."""
    parsed = F.from_json(F.col(json_col), RAW[entity])
    keep = [c for c in ENV if c in df.columns]
    return df.select(*keep, parsed.alias("r")).select(*keep, "r.*")


def login(col: str) -> Column:
    """``user.login`` with a NULL/absent user giving NULL."""
    return F.col(f"{col}.login")


def label_names_json(labels: str = "labels") -> Column:
    """Label names (falsy names dropped) as a JSON array with ``", "`` separators."""
    names = F.filter(
        F.transform(F.col(labels), lambda lab: lab["name"]),
        lambda n: n.isNotNull() & (n != ""),
    )
    def quote(n: Column) -> Column:
        text = F.to_json(F.array(n))  # '["name"]' with JSON escaping
        return text.substr(F.lit(2), F.length(text) - 2)

    quoted = F.transform(names, quote)
    return F.concat(F.lit("["), F.array_join(F.coalesce(quoted, F.array()), ", "), F.lit("]"))


def issues_only(feed: DataFrame) -> DataFrame:
    """The issues endpoint also lists PRs; keep records without ``pull_request``."""
    return feed.where(F.col("pull_request").isNull())


def normalise_repository(feed: DataFrame, fetched_at: Column) -> DataFrame:
    return feed.select(
        F.col("full_name").alias(REPO),
        "description",
        F.coalesce("stargazers_count", F.lit(0)).cast("int").alias("stars"),
        F.coalesce("forks_count", F.lit(0)).cast("int").alias("forks"),
        F.coalesce("subscribers_count", "watchers_count", F.lit(0)).cast("int").alias("watchers"),
        F.coalesce("open_issues_count", F.lit(0)).cast("int").alias("open_issues"),
        "default_branch",
        "language",
        F.coalesce(
            F.nullif(F.col("license.spdx_id"), F.lit("")), F.nullif(F.col("license.name"), F.lit(""))
        ).alias("license_name"),
        parse_timestamp("created_at").alias("created_at"),
        parse_timestamp("updated_at").alias("updated_at"),
        parse_timestamp("pushed_at").alias("pushed_at"),
        fetched_at.alias("fetched_at"),
        *[c for c in ("arrival_seq",) if c in feed.columns],
    )


def normalise_issues(feed: DataFrame) -> DataFrame:
    return issues_only(feed).select(
        REPO,
        F.col("number").alias("issue_number"),
        "state",
        login("user").alias("author"),
        "title",
        label_names_json().alias("labels_json"),
        F.coalesce("comments", F.lit(0)).alias("comments"),
        F.coalesce("locked", F.lit(False)).alias("locked"),
        parse_timestamp("created_at").alias("created_at"),
        parse_timestamp("updated_at").alias("updated_at"),
        parse_timestamp("closed_at").alias("closed_at"),
        "arrival_seq",
    )


def normalise_pull_requests(feed: DataFrame) -> DataFrame:
    return feed.select(
        REPO,
        F.col("number").alias("pr_number"),
        "state",
        login("user").alias("author"),
        "title",
        F.coalesce("draft", F.lit(False)).alias("draft"),
        F.coalesce("comments", F.lit(0)).alias("comments"),
        F.coalesce("review_comments", F.lit(0)).alias("review_comments"),
        parse_timestamp("created_at").alias("created_at"),
        parse_timestamp("updated_at").alias("updated_at"),
        parse_timestamp("closed_at").alias("closed_at"),
        parse_timestamp("merged_at").alias("merged_at"),
        "merge_commit_sha",
        "arrival_seq",
    )


def normalise_commits(feed: DataFrame) -> DataFrame:
    """Author = login else the commit author name; time = committer date else
    author date; records with neither date are dropped."""
    authored = parse_timestamp("commit.author.date")
    committed = F.coalesce(parse_timestamp("commit.committer.date"), authored)
    return feed.select(
        REPO,
        "sha",
        F.coalesce(login("author"), F.col("commit.author.name")).alias("author"),
        F.col("commit.message").alias("message"),
        authored.alias("authored_at"),
        committed.alias("committed_at"),
        "arrival_seq",
    ).where(F.col("committed_at").isNotNull())


def normalise_releases(feed: DataFrame) -> DataFrame:
    return feed.select(
        REPO,
        F.col("id").alias("release_id"),
        "tag_name",
        "name",
        login("author").alias("author"),
        F.coalesce("draft", F.lit(False)).alias("draft"),
        F.coalesce("prerelease", F.lit(False)).alias("prerelease"),
        parse_timestamp("created_at").alias("created_at"),
        parse_timestamp("published_at").alias("published_at"),
        "arrival_seq",
    )


def issue_number_from_url(url: str | Column) -> Column:
    """Integer tail of an issue URL (``.../issues/42`` -> 42); NULL if not numeric.

    The ``(?:^|/)`` anchor makes the number the whole last path segment.
    """
    u = F.col(url) if isinstance(url, str) else url
    tail = F.regexp_extract(u, r"(?:^|/)([0-9]+)/*$", 1)
    return F.nullif(tail, F.lit("")).try_cast("int")


def normalise_issue_comments(feed: DataFrame) -> DataFrame:
    rows = feed.select(
        REPO,
        issue_number_from_url("issue_url").alias("issue_number"),
        F.col("id").alias("comment_id"),
        login("user").alias("author"),
        "body",
        parse_timestamp("created_at").alias("created_at"),
        "arrival_seq",
    )
    return rows.where(F.col("issue_number").isNotNull() & F.col("created_at").isNotNull())


def normalise_pr_reviews(feed: DataFrame) -> DataFrame:
    rows = feed.select(
        REPO,
        F.col("pr_number").cast("long").alias("pr_number"),
        F.col("id").alias("review_id"),
        login("user").alias("author"),
        "state",
        "body",
        parse_timestamp("submitted_at").alias("submitted_at"),
        "arrival_seq",
    )
    return rows.where(F.col("submitted_at").isNotNull())


NORMALISERS = {
    "issues": normalise_issues,
    "pull_requests": normalise_pull_requests,
    "commits": normalise_commits,
    "releases": normalise_releases,
    "issue_comments": normalise_issue_comments,
    "pr_reviews": normalise_pr_reviews,
}


# --- repository identifiers (PRJ12) ------------------------------------------------------------


def repository_id(raw: str | Column) -> Column:
    """``owner/name`` after trimming spaces and outer slashes, or NULL when the
    value is not exactly two non-empty parts or uses ``.``/``..`` as a part."""
    c = F.col(raw) if isinstance(raw, str) else raw
    value = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^/+|/+$", "")
    parts = F.split(value, "/")
    owner, name = F.get(parts, 0), F.get(parts, 1)
    ok = (
        (F.size(parts) == 2)
        & (F.length(owner) > 0)
        & (F.length(name) > 0)
        & ~owner.isin(".", "..")
        & ~name.isin(".", "..")
    )
    return F.when(ok, value)
