"""Registered Structured Streaming queries (run to completion with availableNow)."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.operators.kpis import REPO
from keelson.plans.catalog import register
from keelson.plans.oracle import not_bot, with_bindings
from keelson.plans.q_ingest import UPSERT_COMMITS_SQL
from keelson.schemas import ENVELOPE, KEYS, RAW
from keelson.session import scratch_path
from keelson.sources import feeds, landing
from keelson.sources.bucketed import BucketedTable
from keelson.sources.warehouse import TABLE_BUCKETS, table_path
from keelson.streaming import responses
from keelson.streaming.activity import run_activity_stream
from keelson.streaming.coverage import fold as coverage_fold
from keelson.streaming.upsert import run_table_stream, run_upsert_stream


@register(
    "activity_stream",
    with_bindings(
        """
, counts AS (
  SELECT repo_full_name, time_bucket(INTERVAL 1 DAY, ts) AS window_start,
         time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
         event_type AS activity_type, count(*) AS activity_count
  FROM ev GROUP BY ALL)
SELECT * FROM counts
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE"""
    ),
    "INC9: watermarked 1-day activity counts; append mode emits closed windows only",
)
def _activity_stream(b):
    return run_activity_stream(b, scratch_path(b.spark, f"activity-{uuid.uuid4().hex}"))


@register(
    "stream_upsert_commits",
    UPSERT_COMMITS_SQL,
    "INC3: commits landed per day, merged batch by batch with foreachBatch",
)
def _stream_upsert_commits(b):
    spark = b.spark
    base = scratch_path(spark, f"commit-stream-{uuid.uuid4().hex}")
    # The landed commit feed (one folder per day) is consumed as a file stream.
    schema = StructType(ENVELOPE.fields + RAW["commits"].fields)
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 64)
        .json(landing.land(b, "commits"))
    )
    rows = feeds.normalise_commits(stream)
    table = BucketedTable(spark, os.path.join(base, "table")).create(rows.schema, KEYS["commits"], ["arrival_seq"], TABLE_BUCKETS)
    return run_table_stream(rows, table, os.path.join(base, "checkpoint"), "commits")


@register(
    "stream_coverage_fold",
    with_bindings(
        """
, stats AS (
  SELECT repo_full_name, entity_type, run_day, count(*) AS pages,
         bool_or(items = 100) AS truncated, max(fetched_at) AS refreshed_at
  FROM page_log GROUP BY repo_full_name, entity_type, run_day)
SELECT repo_full_name, entity_type, max(run_day) AS last_run_day,
       arg_max(pages, run_day) AS last_pages, arg_max(truncated, run_day) AS last_truncated,
       bool_or(truncated) AS ever_truncated, max(refreshed_at) AS refreshed_at
FROM stats GROUP BY repo_full_name, entity_type"""
    ),
    "INC7: streaming history-completeness fold over the page log (foreachBatch state)",
)
def _stream_coverage_fold(b):
    spark = b.spark
    base = scratch_path(spark, f"coverage-stream-{uuid.uuid4().hex}")
    # The stored page log is consumed as a file stream, a few files per batch.
    source = table_path(b, "page_log")
    schema = b.stored().page_log.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(source)
    return run_upsert_stream(
        stream,
        os.path.join(base, "state"),
        os.path.join(base, "checkpoint"),
        coverage_fold,
    )


#: Items and events land in periods that end at these instants.
PERIODS = [datetime(1996, 7, 1), datetime(1998, 1, 1), datetime(1999, 7, 1), datetime(2100, 1, 1)]


@register(
    "live_first_response",
    with_bindings(
        f"""
, ends AS (
  SELECT least((SELECT max(created_at) FROM issues), (SELECT max(created_at) FROM issue_comments WHERE {not_bot("author")}))
         - INTERVAL 1 DAY AS passed),
answered AS (
  SELECT i.repo_full_name, i.issue_number, any_value(i.created_at) AS created_at, min(c.created_at) AS first_response_at
  FROM issues i LEFT JOIN issue_comments c ON c.repo_full_name = i.repo_full_name AND c.issue_number = i.issue_number
       AND {not_bot("c.author")} AND c.author <> i.author
       AND c.created_at BETWEEN i.created_at - INTERVAL {responses.BEFORE_DAYS} DAY AND i.created_at + INTERVAL {responses.AFTER_DAYS} DAY
  GROUP BY ALL)
SELECT repo_full_name, issue_number AS number, created_at, first_response_at FROM answered
WHERE first_response_at IS NOT NULL OR created_at + INTERVAL {responses.AFTER_DAYS} DAY < (SELECT passed FROM ends)"""
    ),
    "M13/INC9: first responses by a join of two streams; unanswered items once the watermark has passed them",
)
def _live_first_response(b):
    spark, t = b.spark, b.stored()
    base = scratch_path(spark, f"live-{uuid.uuid4().hex}")
    parts = {
        "items": t.issues.select(REPO, F.col("issue_number").alias("number"), "author", "created_at"),
        "events": t.issue_comments.select(REPO, F.col("issue_number").alias("number"), "author", F.col("created_at").alias("at")),
    }
    streams = []
    ends = responses.instants([(rows, rows.columns[-1]) for rows in parts.values()], PERIODS)
    for name, rows in parts.items():
        folder = os.path.join(base, name)
        responses.land_in_time_order(rows, rows.columns[-1], ends, folder)
        streams.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    return responses.run(*streams, base).responses()
