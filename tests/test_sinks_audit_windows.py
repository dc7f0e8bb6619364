"""Run audit, CSV / JSON exports and window resolution."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keelson.functions.time import Window
from keelson.operators import kpis
from keelson.operators.audit import ERROR_TEXT_LIMIT, audited_run, run_state
from keelson.operators.sinks import summary_json, write_csv, write_summary
from keelson.session import scratch_path

from .conftest import NOW, ago, issue, make_tables


def test_audited_runs_record_success_and_failure(spark):
    log = scratch_path(spark, f"runlog-{uuid.uuid4().hex}")
    with audited_run(spark, log, "r1", "owner/repo", max_pages=3) as counts:
        counts["issues"] = 7
    with pytest.raises(RuntimeError):
        with audited_run(spark, log, "r2", "owner/repo", is_incremental=True):
            raise RuntimeError("x" * 5000)
    state = {r["run_id"]: r for r in run_state(spark, log).collect()}
    assert state["r1"]["status"] == "success" and state["r1"]["issues_loaded"] == 7
    assert state["r1"]["max_pages"] == 3 and state["r1"]["finished_at"] is not None
    assert state["r2"]["status"] == "failed" and state["r2"]["is_incremental"] is True
    assert len(state["r2"]["error_message"]) == ERROR_TEXT_LIMIT


def test_csv_and_json_exports(spark):
    t = make_tables(spark, repos=("a/x", "b/y"), issues=[issue(1, ago(3), repo="a/x")])
    out = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    write_csv(kpis.comparison_kpis(t, Window.all(), NOW), os.path.join(out, "comparison"))
    back = spark.read.option("header", True).csv(os.path.join(out, "comparison"))
    assert back.count() == 2 and "issue_close_rate" in back.columns
    write_summary(summary_json(t, Window.all(), NOW), os.path.join(out, "summary"))
    docs = [json.loads(r[0]) for r in spark.read.text(os.path.join(out, "summary")).collect()]
    by_repo = {d["repository"]: d for d in docs}
    assert by_repo["a/x"]["issues"]["total"] == 1 and by_repo["b/y"]["issues"]["total"] == 0
    assert by_repo["b/y"]["issues"]["close_rate"] is None  # NULL kept, not dropped
    assert by_repo["a/x"]["data_quality"][0]["code"] == "coverage_unknown"


def test_named_and_custom_windows(spark):
    as_of = datetime(2026, 6, 1, 12, 0)
    assert Window.named("all", as_of) == Window.all()
    assert Window.named("30d", as_of).start == datetime(2026, 5, 2, 12, 0)
    w = Window.dates(datetime(2026, 1, 1), datetime(2026, 1, 31))
    assert w.start == datetime(2026, 1, 1) and w.end == datetime(2026, 1, 31, 23, 59, 59, 999999)
    df = spark.createDataFrame(
        [(datetime(2026, 1, 31, 23, 59, 59, 999998),), (datetime(2026, 1, 31, 23, 59, 59, 999999),)],
        "ts timestamp",
    )
    # half-open: the last microsecond of the custom end day is excluded
    assert df.where(w.contains("ts")).count() == 1
    assert df.where(w.contains(F.col("ts"))).count() == 1
