"""Places over split ranges, runs by sessions of fetch times, lost pages."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keelson.operators import sessions
from keelson.operators.ranking import ranked

PAGES = "repo_full_name string, entity_type string, page_no long, items int, fetched_at timestamp"


def at(text):
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")


def test_places_of_a_hot_group_span_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).selectExpr("if(id % 10 < 9, 'hot', concat('g', id % 70)) as g", "hash(id) as k", "id")
        out = ranked(df, ["g"], ["k", "id"], "place").withColumn("task", F.spark_partition_id())
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = defaultdict(list)
    for r in rows:
        groups[r.g].append(r)
    assert len(rows) == 20_000
    for g in groups.values():
        assert [r.place for r in sorted(g, key=lambda r: (r.k, r.id))] == list(range(len(g)))


def test_places_with_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, k int")
    assert sorted((r.g or "", r.k, r.position) for r in ranked(df, ["g"], ["k"]).collect()) == [("", 1, 0), ("", 2, 1), ("a", 5, 0)]
    assert ranked(df.limit(0), ["g"], ["k"]).collect() == []


def test_two_runs_a_day_a_run_across_midnight_and_a_lost_page(spark):
    times = ["2024-01-01 09:00:00", "2024-01-01 09:44:59", "2024-01-01 18:00:00", "2024-01-01 23:50:00", "2024-01-02 00:20:00"]
    rows = [("o/r", "issues", n, 100, at(t)) for n, t in zip((1, 2, 3, 5, 6), times, strict=True)]
    rows += [("o/r", "commits", 3, 40, at("2024-01-02 01:04:59")), ("o/s", "issues", 1, 40, at("2024-01-01 09:45:00"))]
    numbered = sessions.numbered_pages(spark.createDataFrame(rows, PAGES), 2)
    runs = {(r.repo_full_name, r.run_started_at, r.entity_type): r for r in sessions.run_summary(numbered).collect()}
    assert {(k[0], k[1]) for k in runs} == {
        ("o/r", at(times[0])), ("o/r", at(times[2])), ("o/r", at(times[3])), ("o/s", at("2024-01-01 09:45:00"))}
    night = runs["o/r", at(times[3]), "issues"]
    assert (night.pages, night.items, night.truncated, night.run_ended_at) == (2, 200, True, at("2024-01-02 01:04:59"))
    assert runs["o/r", at(times[0]), "issues"].truncated and not runs["o/r", at(times[2]), "issues"].truncated
    edge = [("o/t", "issues", 1, 40, at("2024-01-01 09:00:00")), ("o/t", "issues", 2, 40, at("2024-01-01 09:45:00"))]
    assert len(sessions.sessions(spark.createDataFrame(edge, PAGES)).collect()) == 2  # the gap itself ends a run
    lost = sorted((r.entity_type, r.run_started_at, r.first_lost, r.last_lost, r.n_lost) for r in sessions.lost_pages(numbered).collect())
    assert lost == [("commits", at(times[3]), 1, 2, 2), ("issues", at(times[3]), 4, 4, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_match_a_scan_of_sorted_times(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(f"o/{rng.randint(0, 3)}", rng.choice(["issues", "commits"]), n, 40, start + timedelta(seconds=rng.randint(0, 400_000)))
            for n in range(600)]
    want, last = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: (r[0], r[4])):
        if r[0] not in last or r[4] - last[r[0]][1] >= timedelta(minutes=sessions.GAP_MINUTES):
            last[r[0]] = [r[4], r[4]]
        last[r[0]][1] = r[4]
        want[r[0], last[r[0]][0]].add((r[2], r[4]))
    got = defaultdict(set)
    for r in sessions.with_runs(spark.createDataFrame(rows, PAGES)).collect():
        got[r.repo_full_name, r.run_started_at].add((r.page_no, r.fetched_at))
    assert got == want
