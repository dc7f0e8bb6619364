"""Coverage by run: two runs a day, page limits per run, the limit rule on real page numbers; runs found in the log.

Every page is in a run: where a half day has more pages than its limit, further
runs go on. Runs without ids are sessions of fetch times.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from keelson.functions.time import ts_lit
from keelson.operators import coverage as cov
from keelson.operators import incremental as inc
from keelson.operators import rules, runlog, sessions
from keelson.operators.kpis import REPO
from keelson.plans import q_reports as qr
from keelson.plans.catalog import ORDER_AS_OF, register
from keelson.plans.oracle import with_bindings
from keelson.session import scratch_path
from keelson.sources.warehouse import fingerprint

_PAGES = """
, fetched AS (
  SELECT repo_full_name, strftime(ts, '%Y-%m-%d') || CASE WHEN hour(ts) < 12 THEN 'a' ELSE 'b' END AS half_day,
         CASE event_type WHEN 'view' THEN 'issues' WHEN 'click' THEN 'pull_requests' WHEN 'purchase' THEN 'commits'
              WHEN 'signup' THEN 'releases' WHEN 'error' THEN if(event_id % 2 = 0, 'issue_comments', 'pr_reviews') END AS entity_type,
         if(event_id % 200 = 0, 100, 40) AS items, [2, 8, 30][day(ts) % 3 + 1] AS max_pages, ts AS fetched_at,
         row_number() OVER (PARTITION BY repo_full_name, half_day, entity_type ORDER BY event_id) AS nth
  FROM ev),
run_pages AS (
  SELECT *, half_day || CASE WHEN nth > max_pages THEN printf('.%06d', (nth - 1) // max_pages) ELSE '' END AS run_id,
         nth % max_pages = 0 AND items = 100 AS full_at_limit
  FROM fetched),
per_run AS (
  SELECT repo_full_name, entity_type, run_id, count(*) AS pages, sum(items)::BIGINT AS items,
         bool_or(full_at_limit) AS truncated
  FROM run_pages GROUP BY ALL)"""

_COVERED = f"""
, newest AS (
  SELECT repo_full_name, arg_max(run_id, {{'at': fetched_at, 'run': run_id}}) AS run_id,
         arg_max(max_pages, {{'at': fetched_at, 'run': run_id}}) AS max_pages, max(fetched_at) AS refreshed_at
  FROM run_pages GROUP BY repo_full_name),
seen AS (
{qr._OBS}),
history AS (
  SELECT repo_full_name, entity_type, bool_or(truncated) AS ever FROM per_run GROUP BY ALL),
coverage AS (
  SELECT n.repo_full_name, k.entity_type, coalesce(s.record_count, 0) AS record_count, s.first_observed_at, s.last_observed_at,
         coalesce(p.pages, 0)::INTEGER AS pages_fetched, n.max_pages, coalesce(p.truncated, false) AS last_run_truncated,
         NOT coalesce(if(k.entity_type = 'releases', p.truncated, h.ever), false) AS history_complete,
         if(k.entity_type = 'pr_reviews', 'trailing_180_days', 'full_history') AS coverage_scope,
         n.repo_full_name || '@' || n.run_id AS last_run_id, n.refreshed_at
  FROM newest n CROSS JOIN (SELECT unnest([{qr._ENTITIES}]) AS entity_type) k
  LEFT JOIN per_run p ON p.repo_full_name = n.repo_full_name AND p.run_id = n.run_id AND p.entity_type = k.entity_type
  LEFT JOIN history h ON h.repo_full_name = n.repo_full_name AND h.entity_type = k.entity_type
  LEFT JOIN seen s ON s.repo_full_name = n.repo_full_name AND s.entity_type = k.entity_type)"""

register(
    "run_stats_by_run", with_bindings(_PAGES + "\nSELECT * FROM per_run"), "AGG17/INC6 pagination statistics of every run"
)(lambda b: cov.run_stats(b.run_pages, "run_id"))

register(
    "collection_result_by_run",
    with_bindings(
        _PAGES
        + """
SELECT repo_full_name, run_id, """
        + ", ".join(
            f"coalesce(sum(items) FILTER (WHERE entity_type = '{e}'), 0)::BIGINT AS {e}_loaded"
            for e in ("issues", "pull_requests", "commits", "releases", "issue_comments", "pr_reviews")
        )
        + """, sum(items)::BIGINT AS total_loaded,
       coalesce(string_agg(entity_type, ',' ORDER BY entity_type) FILTER (WHERE truncated), '') AS truncated_entities
FROM per_run GROUP BY repo_full_name, run_id"""
    ),
    "AGG21/AGG22: rows loaded and truncated entities of every run",
)(lambda b: inc.collection_results(b.run_pages, "run_id"))

register(
    "coverage_by_run", with_bindings(_PAGES + _COVERED + "\nSELECT * FROM coverage"), "M10/INC6/INC7 coverage by run"
)(lambda b: cov.coverage(b.stored(), b.run_pages, run="run_id"))

register(
    "data_quality_flags_by_run",
    with_bindings(_PAGES + _COVERED + qr._quality_sql() + "\nSELECT * FROM quality"),
    "M11 data-quality flags over coverage by run",
)(lambda b: rules.quality_flags(b.stored(), cov.coverage(b.stored(), b.run_pages, run="run_id"), ORDER_AS_OF))


# --- runs found by their fetch times -----------------------------------------------------------

SESSION_PAGES = 10
_SESSIONS = f"""
, logged AS (
  SELECT repo_full_name, entity_type, page_seq, items, fetched_at,
         row_number() OVER (PARTITION BY repo_full_name, entity_type ORDER BY fetched_at, page_seq) AS page_no
  FROM page_log),
pages AS (
  SELECT *, coalesce(fetched_at - lag(fetched_at) OVER w >= INTERVAL {sessions.GAP_MINUTES} MINUTE, true) AS begins
  FROM logged WHERE page_seq % 97 <> 0 WINDOW w AS (PARTITION BY repo_full_name ORDER BY fetched_at, page_seq)),
in_run AS (
  SELECT *, count(*) FILTER (begins) OVER (PARTITION BY repo_full_name ORDER BY fetched_at, page_seq) AS run_no FROM pages),
numbered AS (
  SELECT *, min(fetched_at) OVER (PARTITION BY repo_full_name, run_no) AS run_started_at,
         max(fetched_at) OVER (PARTITION BY repo_full_name, run_no) AS run_ended_at,
         row_number() OVER (PARTITION BY repo_full_name, run_no, entity_type ORDER BY fetched_at, page_no) AS page,
         lag(page_no, 1, 0) OVER (PARTITION BY repo_full_name, entity_type ORDER BY page_no) AS known
  FROM in_run)"""

register(
    "session_runs",
    with_bindings(
        _SESSIONS
        + f"""
SELECT repo_full_name, run_started_at, run_ended_at, entity_type, count(*) AS pages, sum(items)::BIGINT AS items,
       bool_or(page = {SESSION_PAGES} AND items = 100) AS truncated
FROM numbered GROUP BY ALL"""
    ),
    "AGG17/INC6/N17: runs found by sessions of fetch times, their pages and truncation",
)(lambda b: sessions.run_summary(sessions.numbered_pages(b.feed_pages, SESSION_PAGES)))

register(
    "session_lost_pages",
    with_bindings(
        _SESSIONS
        + """
SELECT repo_full_name, entity_type, run_started_at, known + 1 AS first_lost, page_no - 1 AS last_lost, page_no - known - 1 AS n_lost
FROM numbered WHERE page_no > known + 1"""
    ),
    "AGG21/N17: ranges of pages that no run has, and the run that went on behind them",
)(lambda b: sessions.lost_pages(sessions.numbered_pages(b.feed_pages, SESSION_PAGES)))


# --- the transactional run log -----------------------------------------------------------------

#: Events reach the log in batches that end at these instants.
LOG_BATCHES = (datetime(2024, 1, 11), datetime(2024, 1, 21), datetime(9999, 1, 1))
_LOADED = ", ".join(
    f"CASE WHEN done = 'success' THEN event_id % {k} ELSE CASE WHEN done <> 'running' THEN 0 END END AS {c}"
    for k, c in enumerate(runlog.COUNTS, 3)
)


@register(
    "run_log_fenced",
    with_bindings(
        f"""
, timed AS (
  SELECT repo_full_name, event_id, ts, event_type, props,
         CASE WHEN event_type <> 'view' THEN ts + INTERVAL 1 SECOND * CAST(floor(value * 60) AS BIGINT) END AS finished_at,
         row_number() OVER w AS epoch, lead(ts) OVER w AS next_started_at
  FROM ev WINDOW w AS (PARTITION BY repo_full_name ORDER BY ts, event_id)),
ended AS (
  SELECT *, CASE WHEN event_type = 'view' THEN 'running' WHEN next_started_at <= finished_at THEN 'fenced'
                 WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS done FROM timed)
SELECT repo_full_name, CAST(event_id AS VARCHAR) AS run_id, epoch, ts AS started_at, finished_at, done AS status,
       CASE WHEN event_type = 'error' THEN props END AS error_message, {_LOADED}
FROM ended"""
    ),
    "SNK8/SNK9/INC8: runs opened and closed in batches; stale runs fenced, failures kept, six counts",
)
def _run_log_fenced(b):
    ev = b._ev
    opened = ev.select(
        REPO, F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("nth"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error_message"),
        *[F.lit(None).cast("long").alias(c) for c in runlog.COUNTS],
    )
    end = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60).cast("long") * 1_000_000)
    failed = F.col("event_type") == "error"
    closed = ev.where("event_type <> 'view'").select(
        REPO, F.col("event_id").cast("string").alias("run_id"), end.alias("at"), F.col("event_id").alias("nth"),
        F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, F.col("props")).alias("error_message"),
        *[(F.col("event_id") % k).alias(c) for k, c in enumerate(runlog.COUNTS, 3)],
    )
    events = opened.union(closed)
    log = runlog.RunLog(b.spark, scratch_path(b.spark, f"merged-{fingerprint(b)}/run_log_fenced"))
    since = datetime(1970, 1, 1)
    for number, until in enumerate(LOG_BATCHES):
        if log.table.manifest().applied.get("events", -1) < number:
            log.apply(events.where((F.col("at") >= ts_lit(since)) & (F.col("at") < ts_lit(until))), number)
        since = until
    return log.runs()
