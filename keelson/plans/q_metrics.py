"""Registered metric queries M1-M8, M13-M16 with their DuckDB oracles."""

from __future__ import annotations

from keelson.operators import kpis
from keelson.plans.catalog import (
    ALL,
    EVENT_AS_OF,
    EVENT_AS_OF_SQL,
    ORDER_AS_OF,
    ORDER_AS_OF_SQL,
    RECENT_180,
    RECENT_30_EVENTS,
    register,
    sql_window,
)
from keelson.plans.oracle import not_bot, with_bindings

# The oracles read one frame of items (issues and pull requests) and one of
# contributions; every metric is a single grouped pass from ``repositories``.
_ITEM = """
, item AS (
  SELECT 'issue' AS kind, repo_full_name, issue_number AS number, author, state, false AS draft,
         created_at, closed_at, closed_at AS done_at FROM issues
  UNION ALL
  SELECT 'pr', repo_full_name, pr_number, author, state, draft, created_at, closed_at, merged_at
  FROM pull_requests)"""


def _hours(until: str) -> str:
    return f"date_diff('minute', x.created_at, {until}) / 60.0"


def _from_items(kind: str, window, select: str) -> str:
    return f"""
SELECT r.repo_full_name, {select}
FROM repositories r LEFT JOIN item x
  ON x.repo_full_name = r.repo_full_name AND x.kind = '{kind}' AND {sql_window(window, "x.created_at")}
GROUP BY r.repo_full_name"""


def _duration(until: str, median: str, p90: str) -> str:
    h = _hours(until)
    return f"round(quantile_cont({h}, 0.5), 1) AS {median}, round(quantile_cont({h}, 0.9), 1) AS {p90}"


def _issues(window, as_of: str) -> str:
    return _from_items("issue", window, f"""
  count(x.number) AS total, count(CASE WHEN x.state = 'open' THEN 1 END) AS open, count(CASE WHEN x.state = 'closed' THEN 1 END) AS closed,
  round(count(CASE WHEN x.state = 'closed' THEN 1 END) * 100.0 / nullif(count(x.number), 0), 1) AS close_rate,
  {_duration("x.done_at", "median_close_hours", "p90_close_hours")},
  count(CASE WHEN x.state = 'open' AND x.created_at + INTERVAL 90 DAY < {as_of} THEN 1 END) AS stale_open""")


def _pulls(window) -> str:
    return _from_items("pr", window, f"""
  count(x.number) AS total, count(CASE WHEN x.state = 'open' THEN 1 END) AS open, count(x.done_at) AS merged,
  round(count(x.done_at) * 100.0 / nullif(count(CASE WHEN x.closed_at IS NOT NULL AND x.draft = false THEN 1 END), 0), 1) AS merge_rate,
  {_duration("x.done_at", "median_merge_hours", "p90_merge_hours")}""")


def _per_author(window) -> str:
    """, per_author: one row per repository and author with its contributions."""
    return f"""
, contribution AS (
  SELECT repo_full_name, author, committed_at AS done_on, 1 AS is_commit FROM commits
  UNION ALL SELECT repo_full_name, author, created_at, 0 FROM pull_requests),
per_author AS (
  SELECT repo_full_name, author, sum(is_commit)::BIGINT AS commits, count(*) AS total_activity, max(done_on) AS last_at
  FROM contribution WHERE author IS NOT NULL AND {sql_window(window, "done_on")} GROUP BY ALL)"""


def _contributors(as_of: str) -> str:
    return f"""
SELECT r.repo_full_name, count(a.author) AS contributors,
       count(CASE WHEN a.last_at >= {as_of} - INTERVAL 90 DAY THEN 1 END) AS active_90d,
       coalesce(round(max(a.total_activity) * 100.0 / sum(a.total_activity), 1), 0)::DOUBLE AS top_contributor_share
FROM repositories r LEFT JOIN per_author a USING (repo_full_name) GROUP BY r.repo_full_name"""


def _responses(kind: str, window, names: tuple[str, str, str, str, str]) -> str:
    event, number, at = {
        "issue": ("issue_comments", "issue_number", "created_at"), "pr": ("pr_reviews", "pr_number", "submitted_at"),
    }[kind]
    responded, median, p90, total, missing = names
    return f"""
, answered AS (
  SELECT x.repo_full_name, x.number, any_value(x.created_at) AS created_at,
         min(e.{at}) FILTER (WHERE e.author <> x.author AND {not_bot("e.author")}) AS first_at
  FROM item x LEFT JOIN {event} e ON e.repo_full_name = x.repo_full_name AND e.{number} = x.number
  WHERE x.kind = '{kind}' AND {sql_window(window, "x.created_at")} GROUP BY x.repo_full_name, x.number)
SELECT r.repo_full_name, count(x.first_at) AS {responded}, {_duration("x.first_at", median, p90)},
       count(x.number) AS {total}, count(CASE WHEN x.number IS NOT NULL AND x.first_at IS NULL THEN 1 END) AS {missing}
FROM repositories r LEFT JOIN answered x USING (repo_full_name) GROUP BY r.repo_full_name"""


# --- M1 / M2 ------------------------------------------------------------------------------

register("repositories", with_bindings("SELECT repo_full_name FROM repositories"), "M1 repository list")(
    lambda b: kpis.repositories(b.stored())
)

register(
    "overview",
    with_bindings(
        """
, stored AS (
  SELECT repo_full_name, 1 AS i, 0 AS p, 0 AS c, 0 AS l FROM issues
  UNION ALL SELECT repo_full_name, 0, 1, 0, 0 FROM pull_requests
  UNION ALL SELECT repo_full_name, 0, 0, 1, 0 FROM commits
  UNION ALL SELECT repo_full_name, 0, 0, 0, 1 FROM releases WHERE draft = false)
SELECT r.repo_full_name, r.description, r.stars, r.forks, r.language, r.license_name, r.fetched_at,
       coalesce(sum(i), 0)::BIGINT AS issues, coalesce(sum(p), 0)::BIGINT AS pull_requests,
       coalesce(sum(c), 0)::BIGINT AS commits, coalesce(sum(l), 0)::BIGINT AS releases
FROM repositories r LEFT JOIN stored USING (repo_full_name) GROUP BY ALL"""
    ),
    "M2 overview with lifetime counts",
)(lambda b: kpis.overview(b.stored()))

# --- M3 / M4 ------------------------------------------------------------------------------

register("issue_kpis", with_bindings(_ITEM + _issues(ALL, ORDER_AS_OF_SQL)), "M3 issue KPIs, all history")(
    lambda b: kpis.issue_kpis(b.stored(), ALL, ORDER_AS_OF)
)
register(
    "issue_kpis_180d", with_bindings(_ITEM + _issues(RECENT_180, ORDER_AS_OF_SQL)), "M3 issue KPIs, 180 days"
)(lambda b: kpis.issue_kpis(b.stored(), RECENT_180, ORDER_AS_OF))
register("pr_kpis", with_bindings(_ITEM + _pulls(ALL)), "M4 PR KPIs")(lambda b: kpis.pr_kpis(b.stored(), ALL))

# --- M5 - M8 ------------------------------------------------------------------------------

register(
    "contributor_kpis", with_bindings(_per_author(ALL) + _contributors(EVENT_AS_OF_SQL)), "M5 contributor KPIs"
)(lambda b: kpis.contributor_kpis(b.stored(), ALL, EVENT_AS_OF))
register(
    "contributor_kpis_30d",
    with_bindings(_per_author(RECENT_30_EVENTS) + _contributors(EVENT_AS_OF_SQL)),
    "M5 contributor KPIs, trailing 30 days",
)(lambda b: kpis.contributor_kpis(b.stored(), RECENT_30_EVENTS, EVENT_AS_OF))


def _monthly(window) -> str:
    return f"""{_ITEM}
SELECT repo_full_name, date_trunc('month', done_on) AS month, activity_type, count(*) AS activity_count
FROM (SELECT repo_full_name, created_at AS done_on, CASE kind WHEN 'pr' THEN 'PR' ELSE 'Issue' END AS activity_type FROM item
      UNION ALL SELECT repo_full_name, committed_at, 'Commit' FROM commits)
WHERE {sql_window(window, "done_on")} GROUP BY ALL"""


register("monthly_activity", with_bindings(_monthly(ALL)), "M6 monthly activity")(
    lambda b: kpis.monthly_activity(b.stored(), ALL)
)

_TOP = """
SELECT repo_full_name, row_number() OVER top AS rank, author, commits,
       total_activity - commits AS pull_requests, total_activity
FROM per_author
WINDOW top AS (PARTITION BY repo_full_name ORDER BY total_activity DESC, author)
QUALIFY rank < 13"""

register("top_contributors", with_bindings(_per_author(ALL) + _TOP), "M7 top 12 contributors per repository")(
    lambda b: kpis.top_contributors(b.stored(), ALL, 12)
)

# An author's month 0 is its first month, so a cohort's size is its activity in month 0.
def _retention(window) -> str:
    return f"""{_per_author(window)},
present AS (
  SELECT DISTINCT repo_full_name, author, date_trunc('month', done_on) AS month
  FROM contribution WHERE author IS NOT NULL AND {sql_window(window, "done_on")}),
aged AS (
  SELECT *, min(month) OVER (PARTITION BY repo_full_name, author) AS cohort_month FROM present),
retention AS (
  SELECT repo_full_name, cohort_month, date_diff('month', cohort_month, month) AS month_number,
         max(CASE WHEN month = cohort_month THEN count(*) END) OVER same AS cohort_size,
         count(*) AS active_contributors, round(count(*) * 100.0 / cohort_size, 1) AS retention_rate
  FROM aged GROUP BY repo_full_name, cohort_month, month
  WINDOW same AS (PARTITION BY repo_full_name, cohort_month) QUALIFY month_number <= 12)"""


_RETENTION = _retention(ALL)

register("contributor_retention", with_bindings(_RETENTION + "\nSELECT * FROM retention"), "M8 cohort retention")(
    lambda b: kpis.contributor_retention(b.stored(), ALL)
)
register(
    "retention_matrix",
    with_bindings(
        _RETENTION
        + "\nSELECT repo_full_name, strftime(cohort_month, '%Y-%m') AS cohort, "
        + ", ".join(f"any_value(retention_rate) FILTER (WHERE month_number = {m}) AS month_{m}" for m in range(13))
        + "\nFROM retention GROUP BY repo_full_name, cohort"
    ),
    "AGG23 cohort x month retention pivot",
)(lambda b: kpis.retention_matrix(b.stored(), ALL))

# --- M13 / M14 ----------------------------------------------------------------------------

_ISSUE_NAMES = (
    "responded_issues", "median_first_response_hours", "p90_first_response_hours", "total_issues", "no_response",
)
_PR_NAMES = ("reviewed_prs", "median_first_review_hours", "p90_first_review_hours", "total_prs", "no_review")

register(
    "issue_response_kpis",
    with_bindings(_ITEM + _responses("issue", ALL, _ISSUE_NAMES)),
    "M13 time to first issue response",
)(lambda b: kpis.issue_response_kpis(b.stored(), ALL))
register(
    "pr_response_kpis", with_bindings(_ITEM + _responses("pr", ALL, _PR_NAMES)), "M14 time to first PR review"
)(lambda b: kpis.pr_response_kpis(b.stored(), ALL))
register(
    "pr_response_kpis_180d",
    with_bindings(_ITEM + _responses("pr", RECENT_180, _PR_NAMES)),
    "M14 time to first PR review, trailing 180 days",
)(lambda b: kpis.pr_response_kpis(b.stored(), RECENT_180))

# --- M15 / M16 ----------------------------------------------------------------------------


def _aged_counts(kind: str, total: str, prefix: str, at: str) -> str:
    days = f"date_diff('microsecond', x.created_at, {at}) / 86400e6"
    is_kind = f"x.kind = '{kind}'"
    old = f"count(CASE WHEN {is_kind} AND {days} > 90 THEN 1 END)"
    return f"""
  count(CASE WHEN {is_kind} THEN 1 END) AS {total}, count(CASE WHEN {is_kind} AND {days} > 30 THEN 1 END) AS {prefix}_stale_30, {old} AS {prefix}_stale_90,
  CASE WHEN count(CASE WHEN {is_kind} THEN 1 END) > 0 THEN round_even(100.0 * {old} / count(CASE WHEN {is_kind} THEN 1 END), 1) END AS {prefix}_backlog_90_pct"""


def _backlog(at: str) -> str:
    return f"""{_ITEM}
SELECT r.repo_full_name, {_aged_counts("issue", "open_issues", "issue", at)}, {_aged_counts("pr", "open_prs", "pr", at)}
FROM repositories r LEFT JOIN item x
  ON x.repo_full_name = r.repo_full_name AND x.state = 'open' AND x.created_at < {at}
GROUP BY r.repo_full_name"""


register("backlog_kpis", with_bindings(_backlog(ORDER_AS_OF_SQL)), "M15 backlog ageing")(
    lambda b: kpis.backlog_kpis(b.stored(), ALL, ORDER_AS_OF)
)

def _comparison(window, at: str) -> str:
    return f"""{_ITEM} {_per_author(window)}
SELECT repo_full_name AS repository, r.language, r.stars, i.close_rate AS issue_close_rate,
       i.median_close_hours AS issue_median_close_hours, p.merge_rate AS pr_merge_rate,
       p.median_merge_hours AS pr_median_merge_hours, a.active_90d, a.top_contributor_share
FROM repositories r JOIN ({_issues(window, at)}) i USING (repo_full_name)
JOIN ({_pulls(window)}) p USING (repo_full_name) JOIN ({_contributors(at)}) a USING (repo_full_name)"""


_COMPARISON = _comparison(ALL, EVENT_AS_OF_SQL)

register("comparison_kpis", with_bindings(_COMPARISON), "M16 cross-repository comparison")(
    lambda b: kpis.comparison_kpis(b.stored(), ALL, EVENT_AS_OF)
)

LISTED = ("ASIA/NATION_12", "none/none", "EUROPE/NATION_3", "AFRICA/NATION_0")

register(
    "comparison_list",
    with_bindings(
        f"""{_COMPARISON.replace("SELECT repo_full_name AS repository", ", compared AS (SELECT repo_full_name AS repository")})
SELECT l.position, l.repository, c.* EXCLUDE (repository, active_90d, top_contributor_share),
       coalesce(c.active_90d, 0) AS active_90d, coalesce(c.top_contributor_share, 0.0)::DOUBLE AS top_contributor_share
FROM (VALUES {", ".join(f"({i}::BIGINT, '{n}')" for i, n in enumerate(LISTED))}) l(position, repository)
LEFT JOIN compared c USING (repository)"""
    ),
    "M16/JN11 comparison of a caller's list, in its order",
)(lambda b: kpis.comparison_kpis(b.stored(), ALL, EVENT_AS_OF, list(LISTED)))
