"""M12: prioritised maintainer follow-ups (open issues and PRs), top-k per repository."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.predicates import older_than
from keelson.functions.time import Window, days_between, ts_lit
from keelson.operators.kpis import REPO, with_first_response

# Priority codes (the reference shows localised text for these)
# and the base of item links, ``<base><repo>/issues/<n>`` and ``<base><repo>/pull/<n>``.
HIGH, MEDIUM = "high", "medium"
ITEM_URL_BASE = "https://github.com/"


def _responded(candidates: DataFrame, events: DataFrame, number: str, event_time: str) -> DataFrame:
    """``candidates`` with a flag: at least one qualifying (non-bot, non-self) event."""
    of_open = events.join(candidates.select(REPO, number), [REPO, number], "left_semi")
    found = with_first_response(candidates, of_open, number, event_time)
    return found.withColumn("responded", F.col("first_response_at").isNotNull() & F.col("author").isNotNull())


def _url(kind: str, number: str):
    return F.concat(
        F.lit(ITEM_URL_BASE), F.col(REPO), F.lit(f"/{kind}/"), F.col(number).cast("string")
    )


def maintainer_tasks(tables, window: Window, as_of: datetime, limit: int | None = 20) -> DataFrame:
    """Follow-ups ranked per repository, at most ``limit`` each; ``None``: all of them, unranked (no window)."""
    end = window.end_or(as_of)
    o90 = older_than("created_at", 90, end)
    o30 = older_than("created_at", 30, end)
    o14 = older_than("created_at", 14, end)
    o7 = older_than("created_at", 7, end)
    age = days_between("created_at", ts_lit(end))

    open_issues = tables.issues.where(
        (F.col("state") == "open") & (F.col("created_at") < ts_lit(end))
    ).select(REPO, "issue_number", "author", "title", "created_at")
    issues = _responded(open_issues, tables.issue_comments, "issue_number", "created_at")
    un = ~F.col("responded")
    issue_tasks = issues.where(o30 | (un & o7)).select(
        REPO,
        F.when(o90 | (un & o30), 3).otherwise(2).alias("sort_rank"),
        F.when(o90 | (un & o30), HIGH).otherwise(MEDIUM).alias("priority"),
        F.lit("Issue").alias("task_type"),
        F.col("issue_number").alias("item_number"),
        "title",
        age.alias("age_days"),
        F.when(o90 & un, "open_90d_no_response")
        .when(o90, "open_90d")
        .when(un, "no_response_7d")
        .otherwise("open_30d")
        .alias("reason"),
        _url("issues", "issue_number").alias("url"),
    )

    open_prs = tables.pull_requests.where(
        (F.col("state") == "open") & ~F.col("draft") & (F.col("created_at") < ts_lit(end))
    ).select(REPO, "pr_number", "author", "title", "created_at")
    prs = _responded(open_prs, tables.pr_reviews, "pr_number", "submitted_at")
    ur = ~F.col("responded")
    pr_tasks = prs.where(o30 | (ur & o7)).select(
        REPO,
        F.when(o90 | (ur & o14), 3).otherwise(2).alias("sort_rank"),
        F.when(o90 | (ur & o14), HIGH).otherwise(MEDIUM).alias("priority"),
        F.lit("PR").alias("task_type"),
        F.col("pr_number").alias("item_number"),
        "title",
        age.alias("age_days"),
        F.when(ur, "awaiting_first_review").otherwise("open_30d").alias("reason"),
        _url("pull", "pr_number").alias("url"),
    )

    every = issue_tasks.unionByName(pr_tasks)
    columns = ["priority", "task_type", "item_number", "title", "age_days", "reason", "url"]
    if limit is None:
        return every.select(REPO, *columns)
    w = W.partitionBy(REPO).orderBy(
        F.desc("sort_rank"), F.desc("age_days"), F.asc("task_type"), F.asc("item_number")
    )
    return (
        every.withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= limit)
        .select(REPO, "rank", *columns)
    )
