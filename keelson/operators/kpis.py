"""Repository KPIs computed for every repository in one pass.

Each function takes the entity tables, a :class:`Window` and an ``as_of``
instant (the reference's "now") and returns one DataFrame keyed by
``repo_full_name``. Repositories without data in the window still get a row
(counts 0, rates and medians NULL) because every result is left-joined from
``repositories``.

Scale notes:
* counts and rates are partial aggregates (map-side combine before the
  shuffle), so a repository holding a third of all rows costs one row per
  map task in the exchange;
* exact percentiles are computed from a (repo, value) -> frequency table built
  by a partial aggregate; durations are whole minutes, so a hot repository's
  quantile task sees at most the number of distinct minute values, not rows;
* distinct counts are two-level aggregations ``(repo, author)`` then ``repo``,
  avoiding the ``Expand`` that several ``count(DISTINCT)`` would plan.
"""

from __future__ import annotations

from dataclasses import replace

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.numeric import interpolated_quantiles, round_half_away
from keelson.functions.predicates import not_bot
from keelson.functions.time import Window, month_start, ts_sql

REPO = "repo_full_name"


def round1_sql(x: str) -> str:
    """SQL text of the reference engine's ``round(x, 1)`` for DOUBLE."""
    return f"round(({x}) * 10.0D, 0) / 10.0D"


def rate_sql(num: str, den: str) -> str:
    """SQL text of ``round(100.0 * num / nullif(den, 0), 1)``."""
    return round1_sql(f"100.0D * ({num}) / nullif({den}, 0)")


def _repos(tables) -> DataFrame:
    return tables.repositories.select(REPO)


def for_repository(df: DataFrame, repository: str) -> DataFrame:
    """FLT1: one repository's rows of any all-repositories result (a pushed-down filter)."""
    return df.where(F.col(REPO) == repository)


def merge_by_repo(parts: list[DataFrame]) -> DataFrame:
    """Combine one-row-per-repository frames without joins.

    Each part carries its own (uniquely named) columns; the union of all parts
    is reduced by a single ``groupBy(repo)`` where ``max`` picks the one
    non-NULL value of each column. One small shuffle replaces a chain of
    joins. The first part is the anchor (``repositories``): its repositories
    get a row even where other parts have none, and no other repository does.
    """
    u = parts[0].withColumn("_anchor", F.lit(True))
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    cols = [c for c in u.columns if c != REPO]
    merged = u.groupBy(REPO).agg(*[F.expr(f"max(`{c}`) AS `{c}`") for c in cols])
    return merged.where("_anchor").drop("_anchor")


def finish(df: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = (REPO,)) -> DataFrame:
    """Project ``name -> SQL expression`` (defaults, rates and rounding)."""
    return df.selectExpr(*[f"`{k}`" for k in keep], *[f"{e} AS `{n}`" for n, e in columns.items()])


def _agg(df: DataFrame, *exprs: str) -> DataFrame:
    return df.groupBy(REPO).agg(*[F.expr(e) for e in exprs])


# --- M1 / M2 --------------------------------------------------------------------------


def repositories(tables) -> DataFrame:
    return tables.repositories.select(REPO).orderBy(REPO)


def _overview_parts(tables, x: str = "o_") -> list[DataFrame]:
    kinds = (
        tables.issues.select(REPO, F.lit("i").alias("k"))
        .unionByName(tables.pull_requests.select(REPO, F.lit("p").alias("k")))
        .unionByName(tables.commits.select(REPO, F.lit("c").alias("k")))
        .unionByName(tables.releases.where(~F.col("draft")).select(REPO, F.lit("r").alias("k")))
    )
    counts = _agg(
        kinds,
        f"count_if(k = 'i') AS {x}issues",
        f"count_if(k = 'p') AS {x}pull_requests",
        f"count_if(k = 'c') AS {x}commits",
        f"count_if(k = 'r') AS {x}releases",
    )
    return [counts]


def _overview_cols(x: str = "o_") -> dict[str, str]:
    return {n: f"coalesce({x}{n}, 0)" for n in ("issues", "pull_requests", "commits", "releases")}


REPO_COLUMNS = ("description", "stars", "forks", "language", "license_name", "fetched_at")


def overview(tables) -> DataFrame:
    """Lifetime counts per repository (not windowed); draft releases excluded."""
    r = tables.repositories.select(REPO, *REPO_COLUMNS)
    m = merge_by_repo([r, *_overview_parts(tables)])
    return finish(m, _overview_cols(), keep=(REPO, *REPO_COLUMNS))


# --- M3 / M4 --------------------------------------------------------------------------


def _hours_sql(start: str, end: str) -> str:
    return (
        f"CAST(floor(unix_seconds({end}) / 60) - floor(unix_seconds({start}) / 60) AS DOUBLE) / 60.0D"
    )


def _issue_parts(tables, window: Window, as_of: datetime, x: str = "i_") -> list[DataFrame]:
    """Counts and close-time quantiles in one pass over the windowed issues."""
    end = window.end_or(as_of)
    rows = tables.issues.where(window.contains("created_at")).select(
        REPO,
        "state",
        "created_at",
        F.expr(
            f"CASE WHEN closed_at IS NOT NULL THEN {_hours_sql('created_at', 'closed_at')} END AS h"
        ),
    )
    q = interpolated_quantiles(
        rows,
        [REPO],
        "h",
        {f"{x}median": 0.5, f"{x}p90": 0.9},
        rows_as=f"{x}total",
        counts_if={
            f"{x}open": "state = 'open'",
            f"{x}closed": "state = 'closed'",
            f"{x}stale": f"state = 'open' AND created_at < {ts_sql(end - timedelta(days=90))}",
        },
    )
    return [q]


def _issue_cols(x: str = "i_") -> dict[str, str]:
    return {
        "total": f"coalesce({x}total, 0)",
        "open": f"coalesce({x}open, 0)",
        "closed": f"coalesce({x}closed, 0)",
        "close_rate": rate_sql(f"coalesce({x}closed, 0)", f"coalesce({x}total, 0)"),
        "median_close_hours": round1_sql(f"{x}median"),
        "p90_close_hours": round1_sql(f"{x}p90"),
        "stale_open": f"coalesce({x}stale, 0)",
    }


def issue_kpis(tables, window: Window, as_of: datetime) -> DataFrame:
    """Issues created in the window: counts, close rate, exact median / P90
    close time, and open issues older than 90 days at the window end."""
    m = merge_by_repo([_repos(tables), *_issue_parts(tables, window, as_of)])
    return finish(m, _issue_cols())


def _pr_parts(tables, window: Window, x: str = "p_") -> list[DataFrame]:
    """Counts and merge-time quantiles in one pass over the windowed PRs."""
    rows = tables.pull_requests.where(window.contains("created_at")).select(
        REPO,
        "state",
        "draft",
        "closed_at",
        F.expr(
            f"CASE WHEN merged_at IS NOT NULL THEN {_hours_sql('created_at', 'merged_at')} END AS h"
        ),
    )
    q = interpolated_quantiles(
        rows,
        [REPO],
        "h",
        {f"{x}median": 0.5, f"{x}p90": 0.9},
        values_as=f"{x}merged",
        rows_as=f"{x}total",
        counts_if={
            f"{x}open": "state = 'open'",
            f"{x}closed_nd": "NOT draft AND closed_at IS NOT NULL",
        },
    )
    return [q]


def _pr_cols(x: str = "p_") -> dict[str, str]:
    return {
        "total": f"coalesce({x}total, 0)",
        "open": f"coalesce({x}open, 0)",
        "merged": f"coalesce({x}merged, 0)",
        # numerator: every merged PR (drafts too); denominator: closed non-drafts
        "merge_rate": rate_sql(f"coalesce({x}merged, 0)", f"coalesce({x}closed_nd, 0)"),
        "median_merge_hours": round1_sql(f"{x}median"),
        "p90_merge_hours": round1_sql(f"{x}p90"),
    }


def pr_kpis(tables, window: Window, as_of: datetime | None = None) -> DataFrame:
    m = merge_by_repo([_repos(tables), *_pr_parts(tables, window)])
    return finish(m, _pr_cols())


# --- contributor activity -------------------------------------------------------------


def activity(tables, window: Window, with_type: bool = False) -> DataFrame:
    """Commits and PRs with a known author inside the window: (repo, author, occurred_at)."""
    c = tables.commits.where(F.col("author").isNotNull() & window.contains("committed_at"))
    p = tables.pull_requests.where(F.col("author").isNotNull() & window.contains("created_at"))
    cols_c = [REPO, "author", F.col("committed_at").alias("occurred_at")]
    cols_p = [REPO, "author", F.col("created_at").alias("occurred_at")]
    if with_type:
        cols_c.append(F.lit("Commit").alias("activity_type"))
        cols_p.append(F.lit("PR").alias("activity_type"))
    return c.select(*cols_c).unionByName(p.select(*cols_p))


def _contributor_parts(tables, window: Window, as_of: datetime, x: str = "c_") -> list[DataFrame]:
    cutoff = window.end_or(as_of) - timedelta(days=90)
    per_author = (
        activity(tables, window)
        .groupBy(REPO, "author")
        .agg(F.expr("count(1) AS events"), F.expr("max(occurred_at) AS last_at"))
    )
    return [
        _agg(
            per_author,
            f"count(1) AS {x}contributors",
            f"count_if(last_at >= {ts_sql(cutoff)}) AS {x}active",
            f"max(events) AS {x}max_events",
            f"sum(events) AS {x}sum_events",
        )
    ]


def _contributor_cols(x: str = "c_") -> dict[str, str]:
    return {
        "contributors": f"coalesce({x}contributors, 0)",
        "active_90d": f"coalesce({x}active, 0)",
        "top_contributor_share": f"coalesce({rate_sql(f'{x}max_events', f'{x}sum_events')}, 0.0D)",
    }


def contributor_kpis(tables, window: Window, as_of: datetime) -> DataFrame:
    """Distinct contributors, those active in the 90 days before the window end
    (or ``as_of``), and the busiest contributor's share of all activity."""
    m = merge_by_repo([_repos(tables), *_contributor_parts(tables, window, as_of)])
    return finish(m, _contributor_cols())


def monthly_activity(tables, window: Window) -> DataFrame:
    """Issues, PRs (by creation) and commits (by commit time) per calendar month."""
    a = (
        tables.issues.where(window.contains("created_at"))
        .select(REPO, month_start("created_at").alias("month"), F.lit("Issue").alias("activity_type"))
        .unionByName(
            tables.pull_requests.where(window.contains("created_at")).select(
                REPO, month_start("created_at").alias("month"), F.lit("PR").alias("activity_type")
            )
        )
        .unionByName(
            tables.commits.where(window.contains("committed_at")).select(
                REPO,
                month_start("committed_at").alias("month"),
                F.lit("Commit").alias("activity_type"),
            )
        )
    )
    return a.groupBy(REPO, "month", "activity_type").agg(
        F.count(F.lit(1)).alias("activity_count")
    )


def top_contributors(tables, window: Window, limit: int = 12) -> DataFrame:
    """Top ``limit`` authors per repository by commits + PRs (ties: author name).

    ``row_number() <= limit`` is planned as a WindowGroupLimit, which keeps at
    most ``limit`` rows per repository in each map task before the exchange.
    """
    t = F.col("activity_type")
    per_author = (
        activity(tables, window, with_type=True)
        .groupBy(REPO, "author")
        .agg(
            F.count_if(t == "Commit").alias("commits"),
            F.count_if(t == "PR").alias("pull_requests"),
            F.count(F.lit(1)).alias("total_activity"),
        )
    )
    w = W.partitionBy(REPO).orderBy(F.desc("total_activity"), F.asc_nulls_last("author"))
    return (
        per_author.withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= limit)
        .select(REPO, "rank", "author", "commits", "pull_requests", "total_activity")
    )


def contributor_retention(tables, window: Window) -> DataFrame:
    """Monthly cohorts: first active month inside the window, active authors in
    each of the following 0-12 months, and the retention percentage."""
    from keelson.operators.author_months import months_of, retention

    return with_retention_rate(retention(months_of(activity(tables, window))))


def with_retention_rate(cells: DataFrame) -> DataFrame:
    return cells.select(
        REPO,
        "cohort_month",
        "month_number",
        "cohort_size",
        "active_contributors",
        round_half_away(F.lit(100.0) * F.col("active_contributors") / F.col("cohort_size"), 1).alias(
            "retention_rate"
        ),
    )


def retention_matrix(tables, window: Window) -> DataFrame:
    """Cohort x month pivot of the retention rate (months 0..12 as columns)."""
    r = contributor_retention(tables, window).select(
        REPO,
        F.date_format("cohort_month", "yyyy-MM").alias("cohort"),
        "month_number",
        "retention_rate",
    )
    wide = r.groupBy(REPO, "cohort").pivot("month_number", list(range(13))).agg(
        F.first("retention_rate")
    )
    return wide.select(
        REPO, "cohort", *[F.col(f"`{m}`").alias(f"month_{m}") for m in range(13)]
    )


# --- M13 / M14 first response -----------------------------------------------------------


def with_first_response(items: DataFrame, events: DataFrame, number: str, event_time: str) -> DataFrame:
    """``items`` (one row per repository and number, with ``author``) and ``first_response_at``.

    That is the earliest event by an author who is known, no bot and not the
    item's own. Items and events are one union, reduced twice: to one row per
    (item, author), where an item's own row marks its author's replies, then to
    one row per item, which takes the earliest unmarked time. Both steps combine
    map-side, so a hot item is a row from each task, and nothing is joined.
    Events without an item fall away in the second step.
    """
    rest = [c for c in items.columns if c not in (REPO, number)]
    key, none = [REPO, number, "author"], F.lit(None)
    payload = F.struct(*rest)
    told = events.where(not_bot("author")).select(*key, F.col(event_time).alias("_t"), none.cast(items.select(payload.alias("p")).schema["p"].dataType).alias("_item"))
    own = items.select(*key, none.cast(events.schema[event_time].dataType).alias("_t"), payload.alias("_item"))
    by_author = told.unionByName(own).groupBy(*key).agg(F.min("_t").alias("_t"), F.max("_item").alias("_item"))
    other = F.when(F.col("_item").isNull(), F.col("_t"))
    found = by_author.groupBy(REPO, number).agg(F.min(other).alias("first_response_at"), F.max("_item").alias("_item"))
    return found.where(F.col("_item").isNotNull()).select(REPO, number, "_item.*", "first_response_at")


ISSUE_RESPONSE = (
    "responded_issues",
    "median_first_response_hours",
    "p90_first_response_hours",
    "total_issues",
    "no_response",
)
PR_RESPONSE = ("reviewed_prs", "median_first_review_hours", "p90_first_review_hours", "total_prs", "no_review")


def _response_parts(
    window: Window, items: DataFrame, events: DataFrame, number: str, event_time: str, x: str
) -> list[DataFrame]:
    scoped = items.where(window.contains("created_at")).select(REPO, number, "author", "created_at")
    if window.start or window.end:
        # Only the window's items' events are shuffled for aggregation. Raw events may meet a hot
        # item here; the semi join's event side is one that Spark can split.
        events = events.join(scoped.select(REPO, number), [REPO, number], "left_semi")
    joined = with_first_response(scoped, events, number, event_time)
    # One pass: unresponded items carry a NULL duration, so the quantile pass
    # also yields the responded (non-NULL) and total (all rows) counts.
    hours = joined.select(
        REPO,
        F.expr(
            "CASE WHEN first_response_at IS NOT NULL AND author IS NOT NULL THEN "
            "CAST(floor(unix_seconds(first_response_at) / 60) - floor(unix_seconds(created_at) / 60)"
            " AS DOUBLE) / 60.0D END AS h"
        ),
    )
    q = interpolated_quantiles(
        hours, [REPO], "h", {f"{x}median": 0.5, f"{x}p90": 0.9}, values_as=f"{x}n", rows_as=f"{x}rows"
    )
    return [q]


def _response_cols(labels: tuple[str, str, str, str, str], x: str) -> dict[str, str]:
    count_l, median_l, p90_l, total_l, missing_l = labels
    return {
        count_l: f"coalesce({x}n, 0)",
        median_l: round1_sql(f"{x}median"),
        p90_l: round1_sql(f"{x}p90"),
        total_l: f"coalesce({x}rows, 0)",
        missing_l: f"coalesce({x}rows, 0) - coalesce({x}n, 0)",
    }


def _issue_response_parts(tables, window: Window, x: str = "ir_") -> list[DataFrame]:
    return _response_parts(
        window, tables.issues, tables.issue_comments, "issue_number", "created_at", x
    )


def _pr_response_parts(tables, window: Window, x: str = "pr_") -> list[DataFrame]:
    return _response_parts(window, tables.pull_requests, tables.pr_reviews, "pr_number", "submitted_at", x)


def issue_response_kpis(tables, window: Window, as_of: datetime | None = None) -> DataFrame:
    m = merge_by_repo([_repos(tables), *_issue_response_parts(tables, window)])
    return finish(m, _response_cols(ISSUE_RESPONSE, "ir_"))


def pr_response_kpis(tables, window: Window, as_of: datetime | None = None) -> DataFrame:
    m = merge_by_repo([_repos(tables), *_pr_response_parts(tables, window)])
    return finish(m, _response_cols(PR_RESPONSE, "pr_"))


# --- M15 backlog ---------------------------------------------------------------------


BACKLOG_COUNTS = (
    "open_issues", "issue_stale_30", "issue_stale_90", "open_prs", "pr_stale_30", "pr_stale_90"
)


def _backlog_parts(tables, window: Window, as_of: datetime, x: str = "b_") -> list[DataFrame]:
    end = window.end_or(as_of)
    before_end = F.expr(f"created_at < {ts_sql(end)} AND state = 'open'")
    both = (
        tables.issues.where(before_end).select(REPO, "created_at", F.lit("i").alias("k"))
        .unionByName(
            tables.pull_requests.where(before_end).select(REPO, "created_at", F.lit("p").alias("k"))
        )
    )
    s30, s90 = ts_sql(end - timedelta(days=30)), ts_sql(end - timedelta(days=90))
    return [
        _agg(
            both,
            f"count_if(k = 'i') AS {x}open_issues",
            f"count_if(k = 'i' AND created_at < {s30}) AS {x}issue_stale_30",
            f"count_if(k = 'i' AND created_at < {s90}) AS {x}issue_stale_90",
            f"count_if(k = 'p') AS {x}open_prs",
            f"count_if(k = 'p' AND created_at < {s30}) AS {x}pr_stale_30",
            f"count_if(k = 'p' AND created_at < {s90}) AS {x}pr_stale_90",
        )
    ]


def _backlog_cols(x: str = "b_") -> dict[str, str]:
    def pct(num: str, den: str) -> str:
        # half-to-even on x*10, unlike the other rates
        return f"CASE WHEN {den} > 0 THEN bround((100.0D * {num} / {den}) * 10.0D, 0) / 10.0D END"

    c = {n: f"coalesce({x}{n}, 0)" for n in BACKLOG_COUNTS}
    return {
        "open_issues": c["open_issues"],
        "issue_stale_30": c["issue_stale_30"],
        "issue_stale_90": c["issue_stale_90"],
        "issue_backlog_90_pct": pct(f"{x}issue_stale_90", f"{x}open_issues"),
        "open_prs": c["open_prs"],
        "pr_stale_30": c["pr_stale_30"],
        "pr_stale_90": c["pr_stale_90"],
        "pr_backlog_90_pct": pct(f"{x}pr_stale_90", f"{x}open_prs"),
    }


def backlog_kpis(tables, window: Window, as_of: datetime) -> DataFrame:
    """Open items aged 30 / 90 days at the window end (start is ignored)."""
    m = merge_by_repo([_repos(tables), *_backlog_parts(tables, window, as_of)])
    return finish(m, _backlog_cols())


# --- M16 comparison ----------------------------------------------------------------------


def comparison_kpis(
    tables, window: Window, as_of: datetime, repositories: list[str] | None = None
) -> DataFrame:
    """One row per repository. With an explicit ``repositories`` list, only those
    rows are returned and ``position`` keeps the caller's order; unknown names get
    no contributors and otherwise NULLs. The list reaches every scan first."""
    if repositories is not None:
        spark = tables.repositories.sparkSession
        order = spark.createDataFrame(list(enumerate(repositories)), "position long, repository string")
        listed = order.select(F.col("repository").alias(REPO)).distinct()
        names = ("repositories", "issues", "pull_requests", "commits")
        tables = replace(tables, **{n: getattr(tables, n).join(listed, REPO, "left_semi") for n in names})
    parts = [
        tables.repositories.select(REPO, "language", "stars"),
        *_issue_parts(tables, window, as_of),
        *_pr_parts(tables, window),
        *_contributor_parts(tables, window, as_of),
    ]
    out = compared(parts)
    if repositories is None:
        return out
    found = order.join(out, "repository", "left").na.fill({"active_90d": 0, "top_contributor_share": 0.0})
    return found.select("position", *out.columns)


def compared(parts: list[DataFrame]) -> DataFrame:
    """The comparison's columns from repositories and the parts of issues, PRs and contributors."""
    i, p, c = _issue_cols(), _pr_cols(), _contributor_cols()
    return finish(
        merge_by_repo(parts),
        {
            "repository": REPO,
            "language": "language",
            "stars": "stars",
            "issue_close_rate": i["close_rate"],
            "issue_median_close_hours": i["median_close_hours"],
            "pr_merge_rate": p["merge_rate"],
            "pr_median_merge_hours": p["median_merge_hours"],
            "active_90d": c["active_90d"],
            "top_contributor_share": c["top_contributor_share"],
        },
        keep=(),
    )
