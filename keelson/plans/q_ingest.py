"""Registered ingest queries: feeds, normalisation, upserts, cursors, scope, run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from keelson.functions.time import ts_lit
from keelson.operators import incremental as inc
from keelson.operators.kpis import REPO
from keelson.operators.ranking import ranked
from keelson.operators.upsert import keep_last, upsert
from keelson.plans.catalog import ORDER_AS_OF, ORDER_AS_OF_SQL, REGISTRY, register, sql_ts
from keelson.plans.oracle import with_bindings
from keelson.schemas import KEYS, RUNS, RUNS_DEFAULTS, RUNS_LEGACY_COLUMNS
from keelson.session import scratch_path
from keelson.sources import feeds, landing, paged
from keelson.sources.bucketed import BucketedTable
from keelson.sources.warehouse import TABLE_BUCKETS, fingerprint, keyed_table, publish

STORED_BEFORE = datetime(2001, 1, 1)
SCOPE_STORED_BEFORE = datetime(2001, 5, 1)
COMMIT_BATCH_SPLIT = datetime(2024, 1, 16)
LEGACY_BEFORE = datetime(2024, 1, 16)


# --- feeds and normalisation ------------------------------------------------------------------


@register(
    "feed_issues",
    with_bindings(
        """
SELECT repo_full_name, issue_number, state,
       CASE WHEN issue_number % 50 <> 0 THEN author END AS author, title,
       '["' || title || '"' || CASE WHEN state = 'closed' THEN ', "done"' ELSE '' END || ']'
         AS labels_json,
       CAST(CASE WHEN issue_number % 3 <> 0 THEN issue_number % 7 ELSE 0 END AS INTEGER) AS comments,
       issue_number % 11 = 0 AS locked, created_at, updated_at, closed_at
FROM issues"""
    ),
    "SRC2 + PRJ2/8/9: issue feed parsed, PRs removed, flattened",
)
def _feed_issues(b):
    raw = feeds.read_feed(b.spark, "issues", landing.land(b, "issues"))
    return feeds.normalise_issues(raw).drop("arrival_seq")


@register(
    "feed_since",
    with_bindings(
        f"""
, stored AS (
  SELECT repo_full_name, max(updated_at) - INTERVAL 5 MINUTE AS since
  FROM pull_requests WHERE created_at < {sql_ts(STORED_BEFORE)} GROUP BY repo_full_name)
SELECT p.repo_full_name, p.pr_number,
       CASE WHEN p.pr_number % 97 <> 0 THEN p.updated_at END AS updated_at
FROM pull_requests p LEFT JOIN stored s USING (repo_full_name)
WHERE s.since IS NULL OR p.pr_number % 97 = 0 OR p.updated_at >= s.since"""
    ),
    "SRC3/SRC4 + INC1-2: feed rows at or after the stored cursor minus 5 minutes",
)
def _feed_since(b):
    stored = b.stored().pull_requests.where(F.col("created_at") < ts_lit(STORED_BEFORE))
    since = inc.cursor_of(stored, "updated_at")
    feed = feeds.normalise_pull_requests(
        feeds.read_feed(b.spark, "pull_requests", landing.land(b, "pull_requests"))
    )
    return inc.since_filter(feed, since).select(REPO, "pr_number", "updated_at")


COMMITS_STORED_BEFORE = datetime(2024, 1, 20)


@register(
    "feed_commits_since",
    with_bindings(
        f"""
, stored AS (
  SELECT repo_full_name, max(committed_at) - INTERVAL 5 MINUTE AS since
  FROM commits WHERE committed_at < {sql_ts(COMMITS_STORED_BEFORE)} GROUP BY repo_full_name)
SELECT c.repo_full_name, c.sha, c.author, c.committed_at FROM commits c LEFT JOIN stored s USING (repo_full_name)
WHERE s.since IS NULL OR c.committed_at >= s.since"""
    ),
    "SRC4/INC1-2: commit pages read from each repository's cursor on, newest first, no page behind it",
)
def _feed_commits_since(b):
    commits = b.stored().commits.select(REPO, "sha", "author", "committed_at")
    stored = commits.where(F.col("committed_at") < ts_lit(COMMITS_STORED_BEFORE))
    cursors = stored.groupBy(REPO).agg(F.max("committed_at").alias("since"))
    path = scratch_path(b.spark, f"pages-{fingerprint(b)}/commits")
    publish(b.spark, lambda target: paged.write_pages(commits, "committed_at", ["sha"], target), path)
    return paged.read_since(b.spark, path, commits.schema, "committed_at", cursors).drop("page")


@register(
    "comment_number",
    with_bindings(
        """
SELECT * FROM (
  SELECT page_id, url,
         TRY_CAST(nullif(regexp_extract(url, '(?:^|/)([0-9]+)/*$', 1), '') AS INTEGER)
           AS issue_number
  FROM pages) WHERE issue_number IS NOT NULL"""
    ),
    "SRC6/FN13: issue number from the URL tail; unparsable rows dropped",
)
def _comment_number(b):
    p = b.table("pages").select("page_id", "url")
    return p.select(
        "page_id", "url", feeds.issue_number_from_url("url").alias("issue_number")
    ).where(F.col("issue_number").isNotNull())


@register(
    "repo_ids",
    with_bindings(
        r"""
, c AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS candidate FROM pages),
n AS (
  SELECT page_id, candidate,
         regexp_replace(regexp_replace(candidate, '^\s+|\s+$', '', 'g'), '^/+|/+$', '', 'g') AS v
  FROM c)
SELECT page_id, candidate,
       CASE WHEN len(str_split(v, '/')) = 2 AND str_split(v, '/')[1] <> ''
             AND str_split(v, '/')[2] <> ''
             AND str_split(v, '/')[1] NOT IN ('.', '..') AND str_split(v, '/')[2] NOT IN ('.', '..')
            THEN v END AS repository
FROM n"""
    ),
    "PRJ12: repository identifier normalisation and validation",
)
def _repo_ids(b):
    p = b.table("pages").select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("candidate")
    )
    return p.select("page_id", "candidate", feeds.repository_id("candidate").alias("repository"))


@register(
    "normalise_repository",
    with_bindings(
        f"""
SELECT repo_full_name,
       CASE WHEN n_nationkey % 4 = 0 THEN 'about ' || repo_full_name END AS description,
       CAST(n_nationkey * 100 AS INTEGER) AS stars,
       CAST(CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 10 ELSE 0 END AS INTEGER) AS forks,
       CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 3 ELSE n_nationkey * 7 END AS INTEGER)
         AS watchers,
       0 AS open_issues, 'main' AS default_branch, r_name AS language,
       CASE WHEN n_nationkey % 3 = 1 THEN 'MIT'
            WHEN n_nationkey % 3 = 2 THEN 'License ' || CAST(n_nationkey AS VARCHAR) END
         AS license_name,
       TIMESTAMP '2000-01-01 00:00:00' AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at,
       CAST(NULL AS TIMESTAMP) AS pushed_at, {ORDER_AS_OF_SQL} AS fetched_at
FROM repo_dim"""
    ),
    "SRC1/PRJ1/SNK1: repository metadata flattened with defaults",
)
def _normalise_repository(b):
    raw = feeds.read_feed(b.spark, "repository", landing.land(b, "repository"))
    snap = upsert(None, feeds.normalise_repository(raw, ts_lit(ORDER_AS_OF)), "repositories")
    return snap.drop("arrival_seq")


@register(
    "normalise_releases",
    with_bindings(
        """
SELECT repo_full_name, release_id, 'v' || CAST(release_id AS VARCHAR) AS tag_name,
       CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS author, draft,
       release_id % 7 = 0 AS prerelease, created_at, published_at
FROM releases"""
    ),
    "SRC5/PRJ5/SNK5/INC4: release feed merged by id; stored releases that the feed lacks stay",
)
def _normalise_releases(b):
    raw = feeds.read_feed(b.spark, "releases", landing.land(b, "releases"))
    batch = feeds.normalise_releases(raw)
    stored = batch.where("release_id % 3 = 0")
    batches = [stored, batch.where("release_id % 3 <> 0")]
    return keyed_table(b, "normalise_releases", "releases", batches).read().drop("arrival_seq")


# --- upserts --------------------------------------------------------------------------------


@register(
    "upsert_keep_last",
    with_bindings(
        """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
             ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM lineitem) WHERE rn = 1"""
    ),
    "WIN1/SNK2-7: keep the last arrival per key (lineitem, duplicate keys)",
)
def _upsert_keep_last(b):
    li = b.table("lineitem")
    return keep_last(
        li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    )


UPSERT_COMMITS_SQL = with_bindings(
    """
, raw AS (
  SELECT repo_full_name, CAST(user_id AS VARCHAR) || '-' || event_type AS sha,
         CASE WHEN user_id % 3 <> 0 THEN 'u' ELSE 'name' END || CAST(user_id AS VARCHAR) AS author,
         props AS message,
         CASE WHEN NOT (event_type = 'error' AND value < 5) THEN ts END AS authored_at,
         coalesce(CASE WHEN event_type <> 'error' THEN ts + INTERVAL 60 SECOND END,
                  CASE WHEN NOT (event_type = 'error' AND value < 5) THEN ts END) AS committed_at,
         event_id AS arrival_seq
  FROM ev)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_full_name, sha ORDER BY arrival_seq DESC) AS rn
  FROM raw WHERE committed_at IS NOT NULL) WHERE rn = 1"""
)


def commit_batches(b):
    """Two landed batches of the commit feed, split on the ``day`` folder
    (partition pruning: each batch lists only its own folders)."""
    feed = feeds.read_feed(b.spark, "commits", landing.land(b, "commits"))
    early = F.col("day") < F.lit(COMMIT_BATCH_SPLIT.date())
    first = feeds.normalise_commits(feed.where(early))
    second = feeds.normalise_commits(feed.where(~early))
    return first, second


@register("upsert_commits", UPSERT_COMMITS_SQL, "SRC4/PRJ4/SNK4: commits in two batches, keep-last")
def _upsert_commits(b):
    return keyed_table(b, "upsert_commits", "commits", list(commit_batches(b))).read()


# Stored issues and PRs are earlier versions (open, as created); the batch replaces some, adds some.
_OLD_SEQ = 1_000_000_000_000


def _earlier(rows):
    return rows.withColumns(
        {
            "state": F.lit("open"),
            "updated_at": F.col("created_at"),
            "closed_at": F.lit(None).cast("timestamp"),
            "arrival_seq": F.col("arrival_seq") - _OLD_SEQ,
        }
    )


@register(
    "upsert_issues",
    with_bindings(
        """
SELECT repo_full_name, issue_number, CASE WHEN (issue_number % 5 <> 0 OR issue_number % 3 = 0) THEN state ELSE 'open' END AS state,
       CASE WHEN issue_number % 50 <> 0 THEN author END AS author, title, created_at,
       CASE WHEN (issue_number % 5 <> 0 OR issue_number % 3 = 0) THEN updated_at ELSE created_at END AS updated_at,
       CASE WHEN (issue_number % 5 <> 0 OR issue_number % 3 = 0) THEN closed_at END AS closed_at
FROM issues"""
    ),
    "SNK2/INC3: an issue batch merged into stored issues, applied twice",
)
def _upsert_issues(b):
    rows = feeds.normalise_issues(feeds.read_feed(b.spark, "issues", landing.land(b, "issues")))
    batch = rows.where("issue_number % 5 <> 0 or issue_number % 3 = 0")
    batches = [_earlier(rows.where("issue_number % 3 <> 0")), batch, batch]
    return keyed_table(b, "upsert_issues", "issues", batches).read().select(
        REPO, "issue_number", "state", "author", "title", "created_at", "updated_at", "closed_at"
    )


@register(
    "upsert_pull_requests",
    with_bindings(
        """
SELECT repo_full_name, pr_number, CASE WHEN (pr_number % 5 <> 0 OR pr_number % 3 = 0) THEN state ELSE 'open' END AS state, author, title,
       draft, 0 AS comments, 0 AS review_comments, created_at,
       CASE WHEN NOT (pr_number % 5 <> 0 OR pr_number % 3 = 0) THEN created_at WHEN pr_number % 97 <> 0 THEN updated_at END AS updated_at,
       CASE WHEN (pr_number % 5 <> 0 OR pr_number % 3 = 0) THEN closed_at END AS closed_at,
       CASE WHEN (pr_number % 5 <> 0 OR pr_number % 3 = 0) THEN merged_at END AS merged_at, CAST(NULL AS VARCHAR) AS merge_commit_sha
FROM pull_requests"""
    ),
    "SRC3/PRJ3/SNK3: a PR batch merged into stored PRs",
)
def _upsert_pull_requests(b):
    rows = feeds.normalise_pull_requests(feeds.read_feed(b.spark, "pull_requests", landing.land(b, "pull_requests")))
    stored = _earlier(rows.where("pr_number % 3 <> 0")).withColumn("merged_at", F.lit(None).cast("timestamp"))
    batches = [stored, rows.where("pr_number % 5 <> 0 or pr_number % 3 = 0")]
    return keyed_table(b, "upsert_pull_requests", "pull_requests", batches).read().drop("arrival_seq")


def _event_batches(b, entity: str):
    """The landed feed in two batches: later arrivals first, so a stored newer version must win."""
    feed = feeds.read_feed(b.spark, entity, landing.land(b, entity))
    rows = feeds.NORMALISERS[entity](feed)
    late = F.col("arrival_seq") % 2 == 1
    return keyed_table(b, f"upsert_{entity}", entity, [rows.where(late), rows.where(~late)]).read().drop("arrival_seq")


@register(
    "upsert_issue_comments",
    with_bindings(
        """
SELECT repo_full_name, CAST(issue_number AS INTEGER) AS issue_number, comment_id,
       CASE WHEN issue_number % 50 <> 0 THEN author END AS author,
       'line ' || (comment_id % 8)::VARCHAR AS body, created_at
FROM issue_comments WHERE issue_number % 41 <> 0"""
    ),
    "SRC6/PRJ6/SNK6/PRJ9: comment feed in every time format, rows without an issue dropped, keep-last",
)
def _upsert_issue_comments(b):
    return _event_batches(b, "issue_comments")


@register(
    "upsert_pr_reviews",
    with_bindings(
        """
SELECT repo_full_name, pr_number, review_id, author,
       CASE WHEN review_id % 8 IN (3, 6) THEN 'APPROVED' ELSE 'COMMENTED' END AS state,
       CASE WHEN review_id % 2 = 0 THEN 'line ' || (review_id % 8)::VARCHAR END AS body, submitted_at
FROM pr_reviews WHERE pr_number % 43 <> 0"""
    ),
    "SRC7/PRJ7/SNK7: review feed, pending reviews dropped, keep-last",
)
def _upsert_pr_reviews(b):
    return _event_batches(b, "pr_reviews")


@register(
    "repository_exists",
    with_bindings(
        r"""
, named AS (
  SELECT n_nationkey, n_name, r_name, CASE n_nationkey % 3 WHEN 0 THEN r_name || '/' || n_name
         WHEN 1 THEN lower(r_name) || '/' || n_name ELSE r_name || '/' || n_name || '_fork' END AS repo_full_name
  FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT repo_full_name, repo_full_name IN (SELECT repo_full_name FROM repositories) AS is_incremental FROM named"""
    ),
    "AGG18: which of the asked repositories are stored already",
)
def _repository_exists(b):
    k, name = F.col("n_nationkey"), F.concat("r_name", F.lit("/"), "n_name")
    other = F.when(k % 3 == 1, F.concat(F.lower("r_name"), F.lit("/"), "n_name")).otherwise(F.concat(name, F.lit("_fork")))
    asked = b.table("nation").join(b.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return inc.repository_exists(b.stored(), asked.select(F.when(k % 3 == 0, name).otherwise(other).alias(REPO)))


# --- cursors, scope, results, run log, schema evolution ----------------------------------------

_CURSOR_PARTS = "\nUNION ALL\n".join(
    f"SELECT repo_full_name, '{e}' AS entity_type, max({c}) AS latest, "
    f"max({c}) - INTERVAL 5 MINUTE AS since FROM {t} GROUP BY repo_full_name"
    for e, t, c in (
        ("issues", "issues", "updated_at"), ("pull_requests", "pull_requests", "updated_at"),
        ("commits", "commits", "committed_at"), ("issue_comments", "issue_comments", "created_at"),
        ("pr_reviews", "pr_reviews", "submitted_at"),
    )
)


@register("cursors", with_bindings(_CURSOR_PARTS), "INC1-2/AGG15/FN14: per-entity cursors")
def _cursors(b):
    return inc.cursors(b.stored())


@register(
    "collection_result",
    with_bindings(
        """
, pe AS (
  SELECT repo_full_name, run_day, entity_type, CAST(sum(items) AS BIGINT) AS items,
         bool_or(items = 100) AS truncated
  FROM page_log GROUP BY repo_full_name, run_day, entity_type)
SELECT repo_full_name, run_day, """
        + ", ".join(
            f"CAST(coalesce(sum(items) FILTER (WHERE entity_type = '{e}'), 0) AS BIGINT) AS {e}_loaded"
            for e in ("issues", "pull_requests", "commits", "releases", "issue_comments", "pr_reviews")
        )
        + """,
       CAST(sum(items) AS BIGINT) AS total_loaded,
       coalesce(string_agg(entity_type, ',' ORDER BY entity_type) FILTER (WHERE truncated), '')
         AS truncated_entities
FROM pe GROUP BY repo_full_name, run_day"""
    ),
    "AGG21/AGG22: rows loaded per run and truncated entities",
)
def _collection_result(b):
    return inc.collection_results(b.stored().page_log)


@register(
    "review_scope",
    with_bindings(
        f"""
, stored AS (SELECT * FROM pull_requests WHERE created_at < {sql_ts(SCOPE_STORED_BEFORE)}),
cur AS (
  SELECT repo_full_name, max(updated_at) - INTERVAL 5 MINUTE AS since
  FROM stored GROUP BY repo_full_name),
newb AS (
  SELECT p.* FROM pull_requests p LEFT JOIN cur USING (repo_full_name)
  WHERE cur.since IS NULL OR p.updated_at >= cur.since),
scope AS (
  SELECT repo_full_name, pr_number FROM newb
  WHERE created_at >= {ORDER_AS_OF_SQL} - INTERVAL 180 DAY
  UNION
  SELECT repo_full_name, pr_number FROM stored
  WHERE created_at >= {ORDER_AS_OF_SQL} - INTERVAL 180 DAY
    AND repo_full_name IN (SELECT repo_full_name FROM cur))
SELECT s.repo_full_name, s.pr_number, count(r.pr_number) AS reviews
FROM scope s LEFT JOIN pr_reviews r
  ON r.repo_full_name = s.repo_full_name AND r.pr_number = s.pr_number
GROUP BY s.repo_full_name, s.pr_number"""
    ),
    "INC5/SET7/SRC7: PRs whose reviews are collected, with review counts",
)
def _review_scope(b):
    prs = b.stored().pull_requests
    stored = prs.where(F.col("created_at") < ts_lit(SCOPE_STORED_BEFORE))
    since = inc.cursor_of(stored, "updated_at")
    new = inc.since_filter(prs, since)
    incremental = since.select(REPO, F.lit(True).alias("is_incremental"))
    scope = inc.review_scope(new, stored, incremental, ORDER_AS_OF)
    counts = (
        inc.reviews_in_scope(b.stored().pr_reviews, scope)
        .groupBy(REPO, "pr_number")
        .agg(F.count(F.lit(1)).alias("reviews"))
    )
    return scope.join(counts, [REPO, "pr_number"], "left").fillna(0, subset=["reviews"])


@register(
    "review_scope_ordered",
    f"SELECT repo_full_name, pr_number, row_number() OVER (PARTITION BY repo_full_name ORDER BY pr_number) - 1 AS position "
    f"FROM ({REGISTRY['review_scope'].oracle})",
    "SRT10: the PR numbers of the review scope in order, each with its place in its repository's list",
)
def _review_scope_ordered(b):
    return ranked(REGISTRY["review_scope"].build(b).select(REPO, "pr_number"), [REPO], ["pr_number"])


@register(
    "run_log",
    with_bindings(
        """
SELECT CAST(event_id AS VARCHAR) AS run_id, repo_full_name, ts AS started_at,
       CASE WHEN event_type <> 'view'
            THEN ts + INTERVAL 1 SECOND * CAST(floor(value * 60) AS BIGINT) END AS finished_at,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END
         AS status,
       CASE WHEN event_type = 'error' THEN props END AS error_message
FROM ev"""
    ),
    "SNK8/SNK9: append-only run events reduced to the current run state",
)
def _run_log(b):
    runs = b.pipeline_runs.join(b._ev.select(F.col("event_id").cast("string").alias("run_id"), "value"), "run_id")
    runs = runs.withColumn(
        "finished_at",
        F.when(
            F.col("status") != "running",
            F.timestamp_micros(
                F.unix_micros("started_at") + F.floor(F.col("value") * 60).cast("long") * 1_000_000
            ),
        ),
    )
    return inc.current_runs(inc.run_events(runs)).select(
        "run_id", REPO, "started_at", "finished_at", "status", "error_message"
    )


@register(
    "schema_evolve",
    with_bindings(
        f"""
SELECT run_id, repo_full_name, started_at, finished_at, status, issues_loaded,
       pull_requests_loaded, commits_loaded, releases_loaded,
       CASE WHEN started_at < {sql_ts(LEGACY_BEFORE)} THEN 0 ELSE 1 END AS issue_comments_loaded,
       CASE WHEN started_at < {sql_ts(LEGACY_BEFORE)} THEN 0 ELSE 1 END AS pr_reviews_loaded,
       CASE WHEN started_at < {sql_ts(LEGACY_BEFORE)} THEN 0 ELSE 10 END AS max_pages,
       started_at >= {sql_ts(LEGACY_BEFORE)} AS is_incremental, error_message
FROM runs"""
    ),
    "SNK14: legacy and current run files read together by the layout that each was written with",
)
def _schema_evolve(b):
    runs = b.stored().pipeline_runs
    legacy_rows = F.col("started_at") < ts_lit(LEGACY_BEFORE)
    legacy = runs.where(legacy_rows).select(*RUNS_LEGACY_COLUMNS)
    current = runs.where(~legacy_rows).withColumns(
        {
            "issue_comments_loaded": F.lit(1),
            "pr_reviews_loaded": F.lit(1),
            "max_pages": F.lit(10),
            "is_incremental": F.lit(True),
        }
    )
    path = scratch_path(b.spark, f"merged-{fingerprint(b)}/schema_evolve")
    table = BucketedTable(b.spark, path).create(legacy.schema, KEYS["pipeline_runs"], ["started_at"], TABLE_BUCKETS)
    table.upsert(legacy, 0)
    table.evolve(RUNS, RUNS_DEFAULTS)  # older files keep their layout and are read with the defaults
    table.upsert(current.select(*RUNS.names), 1)
    return table.read()
