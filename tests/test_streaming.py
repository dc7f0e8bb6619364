"""Streaming results equal their batch twins (closed windows only)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.session import scratch_path
from keelson.sources.bindings import Bindings
from keelson.streaming.activity import activity_counts_batch, run_activity_stream

from .conftest import SF


def test_activity_stream_matches_batch_for_closed_windows(spark):
    b = Bindings(spark, SF)
    streamed = run_activity_stream(b, scratch_path(spark, f"t-activity-{uuid.uuid4().hex}"))
    batch = activity_counts_batch(b._ev)
    cutoff = b.table("events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    import datetime as dt

    closed = batch.where(F.col("window_end") <= F.lit(cutoff - dt.timedelta(minutes=5)))
    assert streamed.exceptAll(closed).count() == 0
    assert closed.exceptAll(streamed).count() == 0
    assert streamed.count() > 0


def test_stream_upsert_equals_batch_upsert(spark):
    import __spark_entry__ as E

    q = E.queries()
    streamed = q["stream_upsert_commits"](spark, SF)
    batch = q["upsert_commits"](spark, SF)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_streamed_coverage_fold_equals_batch_fold(spark):
    import __spark_entry__ as E

    from keelson.streaming.coverage import fold

    streamed = E.queries()["stream_coverage_fold"](spark, SF)
    b = Bindings(spark, SF)
    batch = fold(None, b.stored().page_log).select(*streamed.columns)
    batch = batch.withColumn("refreshed_at", F.col("refreshed_at").cast("timestamp_ntz"))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_fold_is_associative_across_batches(spark):
    from keelson.streaming.coverage import fold

    log = Bindings(spark, SF).stored().page_log
    early = F.col("run_day") < F.lit("2024-01-10").cast("date")
    split = fold(fold(None, log.where(early)), log.where(~early))
    whole = fold(None, log)
    assert split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0


def test_relanded_events_are_counted_once(spark):
    b = Bindings(spark, SF)
    landing = scratch_path(spark, f"t-dup-{uuid.uuid4().hex}")
    events = b.table("events")
    events.unionByName(events).coalesce(1).write.parquet(landing)  # every event landed twice
    streamed = run_activity_stream(b, scratch_path(spark, f"t-dupact-{uuid.uuid4().hex}"), source_dir=landing)
    clean = run_activity_stream(b, scratch_path(spark, f"t-act-{uuid.uuid4().hex}"))
    assert streamed.count() > 0
    assert streamed.exceptAll(clean).count() == 0 and clean.exceptAll(streamed).count() == 0
