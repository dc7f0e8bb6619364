"""Live first responses: several micro-batches, late events counted apart, equal to a batch evaluation."""

from __future__ import annotations

import os
import random
import uuid
from datetime import datetime, timedelta

from keelson.session import scratch_path
from keelson.streaming import responses

T0 = datetime(2024, 1, 1)
ITEM = "repo_full_name string, number long, author string, created_at timestamp"
EVENT = "repo_full_name string, number long, author string, at timestamp"


def streams(spark, items, events, ends):
    base = scratch_path(spark, f"t-live-{uuid.uuid4().hex}")
    out = []
    for name, rows, schema in (("items", items, ITEM), ("events", events, EVENT)):
        folder = os.path.join(base, name)
        df = spark.createDataFrame(rows, schema)
        responses.land_in_time_order(df, df.columns[-1], ends, folder)
        out.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    return base, out


def test_live_equals_batch_and_late_events_are_counted_apart(spark):
    rng = random.Random(4)
    items = [("o/r", n, rng.choice(["ann", "bob", None]), T0 + timedelta(days=rng.randint(0, 700), seconds=n)) for n in range(150)]
    events = [("o/r", rng.randint(0, 170), rng.choice(["ann", "bob", "cy", "dependabot-1", None]),
               T0 + timedelta(days=rng.randint(0, 760), seconds=k)) for k in range(500)]
    ends = [T0 + timedelta(days=d) for d in (200, 400, 600, 2000)]
    base, (i, e) = streams(spark, items, events, ends)
    live = responses.run(i, e, base)
    got = {r.number: (r.created_at, r.first_response_at) for r in live.responses().collect()}
    human = [x for x in events if x[2] and not x[2].startswith("dependabot")]
    passed = min(max(x[3] for x in items), max(x[3] for x in human)) - timedelta(days=1)
    want = {}
    for repo, n, author, at in items:
        near = [x[3] for x in human if x[1] == n and author and x[2] != author
                and at - timedelta(days=responses.BEFORE_DAYS) <= x[3] <= at + timedelta(days=responses.AFTER_DAYS)]
        if near or at + timedelta(days=responses.AFTER_DAYS) < passed:
            want[n] = (at, min(near, default=None))
    assert got == want and any(v[1] is None for v in want.values()) and live.late == 0
    assert live.table.manifest().applied["responses"] >= 3  # several micro-batches


def test_an_event_behind_the_watermark_is_late(spark):
    items = [("o/r", 1, "ann", T0), ("o/r", 2, "ann", T0 + timedelta(days=400)), ("o/r", 3, "ann", T0 + timedelta(days=800))]
    events = [("o/r", 2, "bob", T0 + timedelta(days=410)), ("o/r", 9, "bob", T0 + timedelta(days=800))]
    base, (i, e) = streams(spark, items, events, [T0 + timedelta(days=d) for d in (300, 600, 2000)])
    late = spark.createDataFrame([("o/r", 1, "bob", T0 + timedelta(days=2))], EVENT)
    late.coalesce(1).write.mode("append").parquet(os.path.join(base, "events"))  # lands after the others
    live = responses.run(i, e, base)
    got = {r.number: r.first_response_at for r in live.responses().collect()}
    assert got[1] is None and got[2] == T0 + timedelta(days=410) and live.late >= 1


def test_long_periods_are_landed_in_pieces_so_state_stays_small(spark):
    rng = random.Random(7)
    items = [("o/r", n, "ann", T0 + timedelta(days=rng.randint(0, 3000), seconds=n)) for n in range(600)]
    events = [("o/r", n, rng.choice(["ann", "bob"]), at + timedelta(days=rng.randint(-2, 130))) for _, n, _, at in items * 3]
    ends = [T0 + timedelta(days=1500), T0 + timedelta(days=9000)]
    frames = [(spark.createDataFrame(items, ITEM), "created_at"), (spark.createDataFrame([*events, ("o/r", 1, "bob", None)], EVENT), "at")]
    pieces = responses.instants(frames, ends, 200)
    assert set(ends) < set(pieces) and pieces == sorted(pieces) and 12 <= len(pieces) <= 16
    assert responses.instants(frames, ends) == ends
    base, (i, e) = streams(spark, items, [*events, ("o/r", 1, "bob", None)], pieces)
    for name, time in (("items", "created_at"), ("events", "at")):
        files = sorted((f for f in os.scandir(os.path.join(base, name)) if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)
        times = [[r[0] for r in spark.read.parquet(f.path).select(time).collect()] for f in files]
        assert len(files) == len(pieces) and len({f.stat().st_mtime_ns for f in files}) == len(files)
        assert sum(map(len, times)) == len(items if name == "items" else events) and max(map(len, times)) <= 250
        full = [t for t in times if t]
        assert all(max(a) < min(b) for a, b in zip(full, full[1:], strict=False))
    live = responses.run(i, e, base)
    base, (i, e) = streams(spark, items, events, ends)
    whole = responses.run(i, e, base)
    assert sorted(live.responses().collect()) == sorted(whole.responses().collect()) and live.late == whole.late == 0
    assert live.table.manifest().applied["responses"] >= len(pieces) - 1
    assert live.held < 400 < 1000 < whole.held


def test_late_events_of_all_batches_are_counted(spark):
    """A query remembers the progress of its last batches only."""
    at = [T0 + timedelta(days=200 * k) for k in range(6)]
    ends = [t + timedelta(days=1) for t in at]
    base, (i, e) = streams(spark, [("o/r", n, "ann", t) for n, t in enumerate(at)], [("o/r", 9, "bob", t) for t in at], ends)
    for k in range(6):  # after the first batches each brings one late event
        late = spark.createDataFrame([("o/r", 0, "bob", T0 + timedelta(days=k))], EVENT)
        late.coalesce(1).write.mode("append").parquet(os.path.join(base, "events"))
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        assert responses.run(i, e, base).late == 6
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
