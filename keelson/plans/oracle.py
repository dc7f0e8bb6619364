"""Independent DuckDB SQL for every registered query.

The oracle re-derives each entity from the raw testdata tables with the
binding text of FIXTURES.md §4 (DuckDB dialect) and then states each metric in
its own terms for all repositories at once. Nothing here is shared with the Spark code path.
"""

from __future__ import annotations

BINDINGS = """
repo_dim AS (
  SELECT n_nationkey, concat(r_name, '/', n_name) AS repo_full_name, r_name
  FROM nation JOIN region ON r_regionkey = n_regionkey),
repositories AS (
  SELECT repo_full_name, CAST(NULL AS VARCHAR) AS description, n_nationkey * 100 AS stars,
         n_nationkey * 10 AS forks, r_name AS language, CAST(NULL AS VARCHAR) AS license_name,
         TIMESTAMP '2001-07-29 00:00:00' + INTERVAL '1' HOUR * (n_nationkey * 4) AS fetched_at
  FROM repo_dim),
items AS (
  SELECT d.repo_full_name, o_orderkey AS number, o_orderpriority, o_orderstatus,
         concat('u', CAST(o_custkey AS VARCHAR)) AS author, o_orderpriority AS title,
         o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 7919 % 86400) AS created_at
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN repo_dim d ON d.n_nationkey = c_nationkey),
closed AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
         CASE WHEN o_orderstatus = 'F'
              THEN created_at + INTERVAL '1' MINUTE * (number * 104729 % 108000) END AS closed_at
  FROM items),
issues AS (
  SELECT repo_full_name, number AS issue_number, state, author, title, created_at,
         coalesce(closed_at, created_at) AS updated_at, closed_at
  FROM closed WHERE o_orderpriority >= '3'),
pull_requests AS (
  SELECT repo_full_name, number AS pr_number, state, author, title, number % 17 = 0 AS draft,
         created_at, coalesce(closed_at, created_at) AS updated_at, closed_at,
         CASE WHEN number % 4 <> 0 THEN closed_at END AS merged_at
  FROM closed WHERE o_orderpriority < '3'),
item_events AS (
  SELECT l_orderkey AS number, l_linenumber, l_orderkey * 8 + l_linenumber AS event_id, l_suppkey,
         CASE WHEN l_suppkey % 10 = 0 THEN concat('svc', CAST(l_suppkey AS VARCHAR), '[bot]')
              WHEN l_suppkey % 10 = 1 THEN 'codecov'
              WHEN l_suppkey % 10 = 2 THEN concat('dependabot-', CAST(l_suppkey AS VARCHAR))
              ELSE concat('u', CAST(l_suppkey AS VARCHAR)) END AS author,
         l_shipdate + INTERVAL '1' SECOND * (l_partkey * 31 % 86400) AS created_at
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY created_at DESC, l_suppkey DESC) = 1),
issue_comments AS (
  SELECT i.repo_full_name, e.number AS issue_number, e.event_id AS comment_id, e.author, e.created_at
  FROM item_events e JOIN issues i ON i.issue_number = e.number),
pr_reviews AS (
  SELECT p.repo_full_name, e.number AS pr_number, e.event_id AS review_id, e.author, e.created_at AS submitted_at
  FROM item_events e JOIN pull_requests p ON p.pr_number = e.number),
ev AS (
  SELECT d.repo_full_name, e.* FROM events e
  JOIN customer ON c_custkey = user_id JOIN repo_dim d ON d.n_nationkey = c_nationkey),
commits AS (
  SELECT repo_full_name, CAST(event_id AS VARCHAR) AS sha,
         concat('u', CAST(user_id AS VARCHAR)) AS author, ts AS committed_at FROM ev),
releases AS (
  SELECT repo_full_name, event_id AS release_id, value < 2 AS draft,
         CASE WHEN event_id % 5 <> 0 THEN ts END AS published_at, ts AS created_at
  FROM ev WHERE event_type = 'purchase'),
runs AS (
  SELECT repo_full_name, CAST(event_id AS VARCHAR) AS run_id, ts AS started_at,
         CAST(NULL AS TIMESTAMP) AS finished_at,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END
           AS status,
         0 AS issues_loaded, 0 AS pull_requests_loaded, 0 AS commits_loaded,
         0 AS releases_loaded, 0 AS issue_comments_loaded, 0 AS pr_reviews_loaded,
         0 AS max_pages, false AS is_incremental,
         CASE WHEN event_type = 'error' THEN props END AS error_message FROM ev),
page_log AS (
  SELECT repo_full_name, event_type,
         CASE event_type WHEN 'view' THEN 'issues' WHEN 'click' THEN 'pull_requests'
              WHEN 'purchase' THEN 'commits' WHEN 'signup' THEN 'releases'
              WHEN 'error' THEN 'issue_comments' END AS entity_type,
         CAST(date_trunc('day', ts) AS DATE) AS run_day, event_id AS page_seq,
         CASE WHEN value > 60 THEN 100 ELSE 40 END AS items, ts AS fetched_at FROM ev)
"""


def with_bindings(body: str) -> str:
    """``body`` is either a SELECT or further CTEs starting with ``,``."""
    body = body.strip()
    if body.startswith(","):
        return "WITH " + BINDINGS.strip() + "\n" + body
    return "WITH " + BINDINGS.strip() + "\n" + body


NOT_BOT = r"NOT regexp_matches({c}, '^dependabot|^github-actions|^codecov$|\[bot\]$')"


def not_bot(column: str) -> str:
    return NOT_BOT.format(c=column)
