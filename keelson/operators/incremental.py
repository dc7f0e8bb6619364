"""Incremental collection state: cursors, review scope, run results and run log
(INC1-2, INC5, AGG15, AGG18, AGG21-22, SNK8-9)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.time import ts_lit
from keelson.operators.kpis import REPO

# Overlap subtracted from every cursor, and the review scope.
CURSOR_OVERLAP = timedelta(minutes=5)
REVIEW_WINDOW_DAYS = 180

# Which stored column is the cursor of each incremental entity.
CURSOR_COLUMNS = {
    "issues": ("issues", "updated_at"),
    "pull_requests": ("pull_requests", "updated_at"),
    "commits": ("commits", "committed_at"),
    "issue_comments": ("issue_comments", "created_at"),
    "pr_reviews": ("pr_reviews", "submitted_at"),
}

ENTITIES = ("issues", "pull_requests", "commits", "releases", "issue_comments", "pr_reviews")


def cursors(tables) -> DataFrame:
    """Per (repository, entity): stored maximum of the cursor column and the
    ``since`` value to request next (maximum minus the 5-minute overlap).
    One union + one partial aggregate over all five entity tables."""
    parts = [
        getattr(tables, attr).select(REPO, F.lit(entity).alias("entity_type"), F.col(col).alias("ts"))
        for entity, (attr, col) in CURSOR_COLUMNS.items()
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    latest = u.groupBy(REPO, "entity_type").agg(F.max("ts").alias("latest"))
    minutes = int(CURSOR_OVERLAP.total_seconds() // 60)
    return latest.select(
        REPO,
        "entity_type",
        "latest",
        (F.col("latest") - F.expr(f"INTERVAL {minutes} MINUTES")).alias("since"),
    )


def repository_exists(tables, candidates: DataFrame) -> DataFrame:
    """``candidates`` (repo_full_name) flagged by presence in ``repositories``."""
    known = tables.repositories.select(REPO).withColumn("exists", F.lit(True))
    return candidates.join(known, REPO, "left").select(
        "*", F.coalesce(F.col("exists"), F.lit(False)).alias("is_incremental")
    ).drop("exists")


def since_filter(feed: DataFrame, since: DataFrame, ts_col: str = "updated_at") -> DataFrame:
    """Feed rows newer than the repository's cursor; rows with a NULL time and
    repositories without a cursor are kept (first run = full history)."""
    s = since.select(REPO, F.col("since").alias("_since"))
    ts = F.col(ts_col)
    return (
        feed.join(s, REPO, "left")
        .where(F.col("_since").isNull() | ts.isNull() | (ts >= F.col("_since")))
        .drop("_since")
    )


def review_scope(
    new_prs: DataFrame, stored_prs: DataFrame, incremental: DataFrame, as_of: datetime
) -> DataFrame:
    """PR numbers whose reviews are fetched: created in the trailing 180 days,
    from the new batch, plus stored ones for repositories collected before."""
    cutoff = ts_lit(as_of - timedelta(days=REVIEW_WINDOW_DAYS))
    fresh = new_prs.where(F.col("created_at") >= cutoff).select(REPO, "pr_number")
    stored = (
        stored_prs.where(F.col("created_at") >= cutoff)
        .join(incremental.where("is_incremental").select(REPO), REPO, "left_semi")
        .select(REPO, "pr_number")
    )
    return fresh.unionByName(stored).distinct()


def reviews_in_scope(reviews: DataFrame, scope: DataFrame) -> DataFrame:
    """Reviews of the selected PRs; a PR without reviews simply yields none."""
    return reviews.join(scope, [REPO, "pr_number"], "left_semi")


def collection_results(page_log: DataFrame, run: str = "run_day") -> DataFrame:
    """Per run (repository, ``run``): rows loaded per entity, total, and the
    sorted list of entities whose pagination hit the limit."""
    per_entity = page_log.groupBy(REPO, run, "entity_type").agg(
        F.sum("items").cast("long").alias("items"),
        F.bool_or("limit_hit").alias("truncated"),
    )
    e = F.col("entity_type")
    aggs = [
        F.coalesce(F.sum(F.when(e == name, F.col("items"))), F.lit(0)).cast("long").alias(f"{name}_loaded")
        for name in ENTITIES
    ]
    return per_entity.groupBy(REPO, run).agg(
        *aggs,
        F.sum("items").cast("long").alias("total_loaded"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("truncated"), e))), ","
        ).alias("truncated_entities"),
    )


def run_events(runs: DataFrame) -> DataFrame:
    """Append-only run log: a ``running`` event at start and, for finished
    runs, a terminal event carrying status, end time and error."""
    start = runs.select(
        "run_id", REPO, "started_at",
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit("running").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(0).alias("event_seq"),
    )
    done = runs.where(F.col("status") != "running").select(
        "run_id", REPO, "started_at", "finished_at", "status", "error_message",
        F.lit(1).alias("event_seq"),
    )
    return start.unionByName(done)


def current_runs(events: DataFrame) -> DataFrame:
    """Current state per run = its latest event (replaces UPDATE in place)."""
    from keelson.operators.upsert import keep_last

    return keep_last(events, ["run_id"], ["event_seq"]).drop("event_seq")


def cursor_of(stored: DataFrame, column: str) -> DataFrame:
    """(repo, since) for one stored entity: max(column) minus the overlap."""
    minutes = int(CURSOR_OVERLAP.total_seconds() // 60)
    return stored.groupBy(REPO).agg(
        (F.max(column) - F.expr(f"INTERVAL {minutes} MINUTES")).alias("since")
    )


def replace_releases(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Releases are fetched in full but merged by id: a stored release that the
    batch lacks stays, since a feed cut short must not lose history."""
    from keelson.operators.upsert import upsert

    return upsert(existing, batch, "releases")
