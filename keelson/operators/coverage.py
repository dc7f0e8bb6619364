"""Run log, pagination statistics and collection coverage (M9, M10, AGG16-17, INC6-7).

The reference keeps one mutable coverage row per (repository, entity) and
updates it after every run. Here coverage is *recomputed* from two
append-only inputs -- the page log and the entity tables -- so it is exact,
idempotent on re-run and needs no read-modify-write:

* ``record_count``/first/last observed come from the entity tables;
* ``pages_fetched``/``last_run_truncated`` come from the latest run;
* ``history_complete`` is the conservative fold: for incrementally collected
  entities it is false once any run was truncated; for fully replaced
  entities (releases) only the latest run counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators.kpis import REPO

# Entities, the timestamp each one is observed by, and scopes.
OBSERVED_BY = {
    "issues": ("issues", "created_at"),
    "pull_requests": ("pull_requests", "created_at"),
    "commits": ("commits", "committed_at"),
    "releases": ("releases", "coalesce(published_at, created_at)"),
    "issue_comments": ("issue_comments", "created_at"),
    "pr_reviews": ("pr_reviews", "submitted_at"),
}
FULL_REPLACE = ("releases",)
REVIEW_SCOPE_DAYS = 180
DEFAULT_MAX_PAGES = 10
PER_PAGE = 100


def scope_of(entity: str) -> str:
    return f"trailing_{REVIEW_SCOPE_DAYS}_days" if entity == "pr_reviews" else "full_history"


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Latest ``limit`` runs per repository (newest first)."""
    w = W.partitionBy(REPO).orderBy(F.desc("started_at"), F.desc("run_id"))
    return (
        runs.withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= limit)
        .select(
            REPO,
            "rank",
            "started_at",
            "finished_at",
            "status",
            "issues_loaded",
            "pull_requests_loaded",
            "commits_loaded",
            "releases_loaded",
            "issue_comments_loaded",
            "pr_reviews_loaded",
            "max_pages",
            "is_incremental",
            "error_message",
        )
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """One row per repository: the run with the greatest (started_at, run_id)."""
    latest = F.max_by(
        F.struct("status", "started_at", "finished_at", "error_message", "run_id"),
        F.struct("started_at", "run_id"),
    )
    return runs.groupBy(REPO).agg(latest.alias("r")).select(REPO, "r.*")


def page_limit_hit(page: str, items: str, max_pages: int | str, per_page: int = PER_PAGE) -> Column:
    """INC6: a run is truncated when its last allowed page came back full --
    more data may exist beyond the limit (a conservative false positive when
    the data ends exactly there)."""
    mp = F.col(max_pages) if isinstance(max_pages, str) else F.lit(max_pages)
    return (F.col(page) == mp) & (F.col(items) == per_page)


def run_stats(page_log: DataFrame, run: str = "run_day") -> DataFrame:
    """Pagination statistics per (repository, entity, run): pages, items, truncated.

    ``run`` is the page log's column that tells runs apart.
    """
    return page_log.groupBy(REPO, "entity_type", run).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("items").cast("long").alias("items"),
        F.bool_or("limit_hit").alias("truncated"),
    )


def observed(tables) -> DataFrame:
    """min / max / count of each entity's observation timestamp per repository."""
    parts = []
    for entity, (attr, ts_expr) in OBSERVED_BY.items():
        df = getattr(tables, attr)
        parts.append(
            df.select(REPO, F.lit(entity).alias("entity_type"), F.expr(ts_expr).alias("ts"))
        )
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(REPO, "entity_type").agg(
        F.min("ts").alias("first_observed_at"),
        F.max("ts").alias("last_observed_at"),
        F.count(F.lit(1)).alias("record_count"),
    )


def coverage(
    tables, page_log: DataFrame, max_pages: int = DEFAULT_MAX_PAGES, run: str = "run_day"
) -> DataFrame:
    """Coverage evidence per (repository, entity) for every repository with a run.

    The latest run is the one that fetched last; runs may overlap in time. The page limit
    is the latest run's where the log has a column ``max_pages``, else the parameter.
    """
    limit = F.col("max_pages") if "max_pages" in page_log.columns else F.lit(max_pages)
    newest = F.max_by(F.struct(F.col(run).alias("last_run"), limit.alias("max_pages")), F.struct("fetched_at", run))
    runs = page_log.groupBy(REPO).agg(newest.alias("n"), F.max("fetched_at").alias("refreshed_at"))
    in_last = F.when(F.col(run) == F.col("last_run"), F.struct("pages", "truncated"))
    fold = run_stats(page_log, run).join(runs.select(REPO, "n.last_run"), REPO).groupBy(REPO, "entity_type").agg(
        F.bool_or("truncated").alias("ever_truncated"), F.max(in_last).alias("last")
    )
    entities = F.array(*[F.lit(e) for e in OBSERVED_BY])
    per_entity = runs.select(REPO, "n.*", "refreshed_at", F.explode(entities).alias("entity_type"))
    j = per_entity.join(fold, [REPO, "entity_type"], "left").join(
        observed(tables), [REPO, "entity_type"], "left"
    )
    last_pages = F.coalesce(F.col("last.pages"), F.lit(0)).cast("int")
    last_trunc = F.coalesce(F.col("last.truncated"), F.lit(False))
    complete = F.when(
        F.col("entity_type").isin(*FULL_REPLACE), ~last_trunc
    ).otherwise(~F.coalesce(F.col("ever_truncated"), F.lit(False)))
    scope = F.when(F.col("entity_type") == "pr_reviews", scope_of("pr_reviews")).otherwise(
        scope_of("issues")
    )
    return j.select(
        REPO,
        "entity_type",
        F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"),
        "first_observed_at",
        "last_observed_at",
        last_pages.alias("pages_fetched"),
        "max_pages",
        last_trunc.alias("last_run_truncated"),
        complete.alias("history_complete"),
        scope.alias("coverage_scope"),
        F.concat(F.col(REPO), F.lit("@"), F.col("last_run").cast("string")).alias(
            "last_run_id"
        ),
        "refreshed_at",
    )


# Display labels of completeness and scope.
COMPLETENESS_LABELS = {True: "complete", False: "may be incomplete"}
SCOPE_LABELS = {"trailing_180_days": "PRs of the last 180 days", "full_history": "full history"}


def coverage_view(coverage: DataFrame, entity_labels: dict[str, str]) -> DataFrame:
    """PRJ13: coverage rows relabelled for display (entity, completeness, scope)."""
    label = F.create_map(*[F.lit(x) for kv in entity_labels.items() for x in kv])
    scope = F.create_map(*[F.lit(x) for kv in SCOPE_LABELS.items() for x in kv])
    return coverage.select(
        REPO,
        label[F.col("entity_type")].alias("entity"),
        F.col("record_count").alias("records"),
        F.col("first_observed_at").alias("first_record"),
        F.col("last_observed_at").alias("last_record"),
        F.col("pages_fetched").alias("pages_this_run"),
        F.col("max_pages").alias("page_limit"),
        F.when(F.col("history_complete"), COMPLETENESS_LABELS[True])
        .otherwise(COMPLETENESS_LABELS[False])
        .alias("history"),
        scope[F.col("coverage_scope")].alias("scope"),
    )


def coverage_summary(coverage: DataFrame, runs: DataFrame) -> DataFrame:
    """AGG19: per repository with coverage -- complete entities, entities,
    records stored, latest refresh and the latest run's status."""
    summary = coverage.groupBy(REPO).agg(
        F.expr("count_if(history_complete) AS complete_entities"),
        F.expr("count(1) AS entities"),
        F.expr("sum(record_count) AS records_stored"),
        F.expr("max(refreshed_at) AS latest_refresh"),
    )
    status = latest_run(runs).select(REPO, F.col("status").alias("latest_status"))
    return summary.join(status, REPO, "left")
