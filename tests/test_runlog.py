"""The transactional run log: epochs, fencing, failures, competing writers."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest

from keelson.operators import runlog
from keelson.operators.runlog import RunLog
from keelson.session import scratch_path

T0 = datetime(2024, 1, 1)


def new_log(spark):
    return RunLog(spark, scratch_path(spark, f"t-runs-{uuid.uuid4().hex}"), 4)


def events(spark, *rows):
    """(run, hour, status): an open has no status."""
    return spark.createDataFrame(
        [("o/r", run, T0 + timedelta(hours=h), n, status, "boom" if status == "failed" else None, 5, 4, 3, 2, 1, 0)
         for n, (run, h, status) in enumerate(rows)], runlog.EVENT)


def found(log):
    return {r.run_id: (r.epoch, r.status, r.issues_loaded, r.error_message) for r in log.runs().collect()}


def test_a_stale_run_is_fenced_and_the_newer_one_counts(spark):
    log = new_log(spark)
    log.apply(events(spark, ("a", 0, None), ("b", 1, None), ("a", 2, "success"), ("b", 3, "success"), ("c", 4, None)))
    want = {"a": (1, "fenced", 0, None), "b": (2, "success", 5, None), "c": (3, "running", None, None)}
    assert found(log) == want
    log.apply(events(spark, ("a", 5, "success"), ("c", 6, "failed"), ("d", 6, None)))  # d opens at c's last instant
    want |= {"c": (3, "fenced", 0, "boom"), "d": (4, "running", None, None)}
    assert found(log) == want  # the first close of a stays


def test_a_close_in_a_later_batch_finds_its_open(spark):
    log = new_log(spark)
    log.apply(events(spark, ("a", 0, None)), 0)
    log.apply(events(spark, ("a", 1, "failed"), ("b", 2, None)), 1)
    log.apply(events(spark, ("b", 1, "success")), 1)  # a replayed number
    assert found(log) == {"a": (1, "failed", 0, "boom"), "b": (2, "running", None, None)}


def test_of_two_writers_the_second_is_judged_again(spark, monkeypatch):
    log = new_log(spark)
    log.apply(events(spark, ("a", 0, None)))
    judged, raced = runlog.judged, []

    def race(batch, stored):
        rows = judged(batch, stored)
        if not raced:
            raced.append(1)
            log.apply(events(spark, ("b", 1, None)))  # another collector opens before a's close is committed
        return rows

    monkeypatch.setattr(runlog, "judged", race)
    log.apply(events(spark, ("a", 2, "success")))
    assert found(log) == {"a": (1, "fenced", 0, None), "b": (2, "running", None, None)}


def test_a_failure_is_kept_and_raised_again(spark):
    log = new_log(spark)
    with pytest.raises(ValueError, match="no such page"):
        with log.run("o/r", "a"):
            raise ValueError("no such page" + "!" * 2000)
    with log.run("o/r", "b") as counts:
        counts["issues_loaded"] = 7
    got = found(log)
    assert got["a"][:3] == (1, "failed", 0) and len(got["a"][3]) == 1000
    assert got["b"] == (2, "success", 7, None)
