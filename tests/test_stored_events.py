"""Stored events: versions told apart without sorting, one join for comments and reviews, no shuffle for the files."""

from __future__ import annotations

from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from keelson.operators.upsert import keep_last
from keelson.sources import warehouse
from keelson.sources.bindings import Bindings

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixed_width_versions_are_hashed(spark):
    day = datetime(2024, 1, 2)
    rows = [(1, 5, 10, day, True), (1, None, 99, None, False), (1, 7, None, day, None), (2, None, 3, day, True), (None, 1, 4, None, True),
            (None, 2, 5, day, False), (3, -9, 1, day, True), (3, -10, 2, None, False)]
    df = spark.createDataFrame(rows * 2, "k long, seq long, v long, at timestamp, flag boolean")
    last = keep_last(df, ["k"], ["seq"])
    assert "SortAggregate" not in plan(last) and last.columns == ["k", "seq", "v", "at", "flag"]
    want = {(1, 7, None, day, None), (2, None, 3, day, True), (None, 2, 5, day, False), (3, -9, 1, day, True)}
    assert len(got := [tuple(r) for r in last.collect()]) == 4 and set(got) == want
    texts = keep_last(df.withColumn("text", F.concat(F.lit("t"), "v")), ["k"], ["seq"])  # sorted, as before
    assert {tuple(r)[:5] for r in texts.collect()} == want


def test_comments_and_reviews_share_one_cached_join(spark):
    b = Bindings(spark, SF)
    assert "SortAggregate" not in plan(b.item_events)
    with b.shared_inputs():
        for df in (b.issue_comments, b.pr_reviews):
            assert "Exchange" not in plan(df).split("InMemoryRelation")[0]  # the join and its shuffles lie below the cache
    both = b.issue_comments.select("comment_id").unionAll(b.pr_reviews.select("review_id"))
    ids = b.item_events.join(b._items.where("o_orderpriority is not null"), "number").select("event_id")
    assert both.exceptAll(ids).count() == ids.exceptAll(both).count() == 0


def test_tables_are_written_in_small_parts(spark, monkeypatch, tmp_path):
    scan, advice = warehouse.PART_SETTINGS
    before = {name: spark.conf.get(name) for name in warehouse.PART_SETTINGS}
    seen = []

    def write(df, path, time_col):
        seen.append([spark.conf.get(name) for name in warehouse.PART_SETTINGS])
        raise InterruptedError

    monkeypatch.setattr(warehouse, "write_table", write)
    try:
        spark.conf.set(scan, "128MB")
        spark.conf.set(advice, "2m")  # asks for less, and gets it
        with pytest.raises(InterruptedError):
            warehouse.store(spark, SimpleNamespace(**dict.fromkeys(warehouse.LAYOUT)), str(tmp_path))
        assert seen and all(x == [str(8 << 20), str(2 << 20)] for x in seen)
        assert [spark.conf.get(name) for name in warehouse.PART_SETTINGS] == ["128MB", "2m"]  # also after a failure
    finally:
        for name, size in before.items():
            spark.conf.set(name, size)
