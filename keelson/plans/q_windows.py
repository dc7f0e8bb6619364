"""Metrics over windows with an end, evidence known at an instant, ordered lists, CSV exports.

Two windows of the order-based entities are registered. Over four and a half
months some backlogs are stale without being aged; over two days repositories
differ enough that concentration, merge-rate and first-response rules both fire
and don't.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from keelson.functions.time import Window, ts_lit
from keelson.operators import coverage as cov
from keelson.operators import kpis, rules, sinks, tasks
from keelson.operators import report as rep
from keelson.operators.ordering import in_order
from keelson.plans import q_metrics as qm
from keelson.plans import q_reports as qr
from keelson.plans.catalog import ALL, EVENT_AS_OF, ORDER_AS_OF, ORDER_AS_OF_SQL, REGISTRY, register, sql_ts
from keelson.plans.oracle import with_bindings
from keelson.session import scratch_path

SPRING = Window.dates(datetime(1999, 1, 1), datetime(1999, 5, 15))
SPRING_END = "TIMESTAMP '1999-05-15 23:59:59.999999'"
TWO_DAYS = Window.dates(datetime(1999, 3, 1), datetime(1999, 3, 2))
TWO_DAYS_END = "TIMESTAMP '1999-03-02 23:59:59.999999'"
#: Commits fall in January 2024.
JANUARY = Window(datetime(2024, 1, 5), datetime(2024, 1, 20, 12))
JANUARY_END = "TIMESTAMP '2024-01-20 12:00:00'"

# --- windows with an end ---------------------------------------------------------------------

register(
    "issue_kpis_dates", with_bindings(qm._ITEM + qm._issues(SPRING, SPRING_END)), "M3/FLT3 issue KPIs of given dates"
)(lambda b: kpis.issue_kpis(b.stored(), SPRING, ORDER_AS_OF))
register("pr_kpis_dates", with_bindings(qm._ITEM + qm._pulls(SPRING)), "M4/FLT3 PR KPIs of given dates")(
    lambda b: kpis.pr_kpis(b.stored(), SPRING)
)
register(
    "contributor_kpis_dates",
    with_bindings(qm._per_author(JANUARY) + qm._contributors(JANUARY_END)),
    "M5/N1 contributors, active at the window's end",
)(lambda b: kpis.contributor_kpis(b.stored(), JANUARY, EVENT_AS_OF))
register("monthly_activity_dates", with_bindings(qm._monthly(SPRING)), "M6 monthly activity of given dates")(
    lambda b: kpis.monthly_activity(b.stored(), SPRING)
)
register(
    "top_contributors_dates", with_bindings(qm._per_author(JANUARY) + qm._TOP), "M7 top contributors of a window"
)(lambda b: kpis.top_contributors(b.stored(), JANUARY, 12))
register(
    "contributor_retention_dates",
    with_bindings(qm._retention(SPRING) + "\nSELECT * FROM retention"),
    "M8 cohorts of given dates",
)(lambda b: kpis.contributor_retention(b.stored(), SPRING))
register(
    "issue_response_kpis_dates",
    with_bindings(qm._ITEM + qm._responses("issue", TWO_DAYS, qm._ISSUE_NAMES)),
    "M13 first responses to issues of given dates",
)(lambda b: kpis.issue_response_kpis(b.stored(), TWO_DAYS))
register(
    "pr_response_kpis_dates",
    with_bindings(qm._ITEM + qm._responses("pr", SPRING, qm._PR_NAMES)),
    "M14 first reviews of PRs of given dates",
)(lambda b: kpis.pr_response_kpis(b.stored(), SPRING))
register("backlog_kpis_dates", with_bindings(qm._backlog(SPRING_END)), "M15/N10 backlog at the window's end")(
    lambda b: kpis.backlog_kpis(b.stored(), SPRING, ORDER_AS_OF)
)
register("comparison_kpis_dates", with_bindings(qm._comparison(SPRING, SPRING_END)), "M16 comparison of given dates")(
    lambda b: kpis.comparison_kpis(b.stored(), SPRING, EVENT_AS_OF)
)
register(
    "maintainer_tasks_dates",
    with_bindings(qr._tasks_sql(20, SPRING_END) + "\nSELECT * FROM tasks"),
    "M12/N11 tasks, aged at the window's end",
)(lambda b: tasks.maintainer_tasks(b.stored(), SPRING, ORDER_AS_OF, 20))

for _name, _window, _end in (("spring", SPRING, SPRING_END), ("two_days", TWO_DAYS, TWO_DAYS_END)):
    register(
        f"risk_flags_{_name}",
        with_bindings(qr._kpi_sql(_window, _end) + qr.RISK_SQL + "\nSELECT * FROM risks"),
        "M17 risk flags of given dates (rules K1-K5)",
    )(lambda b, w=_window: rules.risk_flags(b.stored(), w, w.end))


def _report(b, window: Window):
    return rep.build_report(b.stored(), cov.coverage(b.stored(), b.stored().page_log), window, window.end)


register(
    "report_metrics_dates",
    with_bindings(qr._report_sql(TWO_DAYS, TWO_DAYS_END) + qr.REPORT_SELECT),
    "M18 report metrics of given dates",
)(lambda b: _report(b, TWO_DAYS)[0])
register(
    "report_findings_dates",
    with_bindings(qr._findings_sql(TWO_DAYS, TWO_DAYS_END)),
    "M18 report findings of given dates (rules P1-P12)",
)(lambda b: _report(b, TWO_DAYS)[1])

#: Three weeks in which some repositories merge fast and some leave issues unanswered.
WEEKS = Window.dates(datetime(1997, 6, 24), datetime(1997, 7, 14))
WEEKS_END = "TIMESTAMP '1997-07-14 23:59:59.999999'"
register(
    "report_findings_weeks",
    with_bindings(qr._findings_sql(WEEKS, WEEKS_END)),
    "M18 report findings of three weeks (rules P6 and P8 too)",
)(lambda b: _report(b, WEEKS)[1])

# --- one repository ----------------------------------------------------------------------------

ONE = "ASIA/NATION_12"
for _name in ("issue_kpis", "pr_kpis", "contributor_kpis", "backlog_kpis", "maintainer_tasks"):
    register(
        f"{_name}_one",
        f"SELECT * FROM ({REGISTRY[_name].oracle}) WHERE repo_full_name = '{ONE}'",
        f"FLT1 {REGISTRY[_name].description}, of one repository",
    )(lambda b, q=REGISTRY[_name]: kpis.for_repository(q.build(b), ONE))

# --- evidence known at an instant: rules R3 and R7 fire for some repositories -----------------

KNOWN_BEFORE = datetime(2024, 1, 1, 0, 10)
FRESH_AS_OF = datetime(2001, 7, 31, 12)


def _known_early(b):
    t = b.stored()
    pages = t.page_log.where(F.col("fetched_at") < ts_lit(KNOWN_BEFORE))
    runs = t.pipeline_runs.where(F.col("started_at") < ts_lit(KNOWN_BEFORE))
    return rules.quality_flags(replace(t, pipeline_runs=runs), cov.coverage(t, pages), FRESH_AS_OF)


register(
    "data_quality_flags_early",
    with_bindings(
        f"""
, early_pages AS (SELECT * FROM page_log WHERE fetched_at < {sql_ts(KNOWN_BEFORE)}),
early_runs AS (SELECT * FROM runs WHERE started_at < {sql_ts(KNOWN_BEFORE)})"""
        + qr.COVERAGE_SQL.replace("FROM page_log", "FROM early_pages")
        + qr._quality_sql(sql_ts(FRESH_AS_OF)).replace("FROM runs", "FROM early_runs")
        + "\nSELECT * FROM quality"
    ),
    "M11 data-quality flags from the evidence known at an instant (rules R1-R7)",
)(_known_early)

# --- lists in order ----------------------------------------------------------------------------


def _ordered(name: str, sql_order: str, *order) -> None:
    query = REGISTRY[name]
    register(
        f"{name}_ordered",
        f"SELECT *, row_number() OVER (PARTITION BY repo_full_name ORDER BY {sql_order}) - 1 AS position "
        f"FROM ({query.oracle})",
        f"{query.description}, with each row's place in its repository's list",
    )(lambda b: in_order(query.build(b), *map(F.expr, order)))


_ordered("monthly_activity", "month, activity_type", "month", "activity_type")
_ordered("contributor_retention", "cohort_month, month_number", "cohort_month", "month_number")
_ordered("coverage", "entity_type", "entity_type")
_ordered("top_contributors", "total_activity, rank DESC", "total_activity", "-rank")

# --- exports -----------------------------------------------------------------------------------


def _through_csv(b, df):
    """``df`` written as CSV and read back with its schema."""
    path = scratch_path(b.spark, f"export-{uuid.uuid4().hex}")
    sinks.write_csv(df, path)
    return b.spark.read.schema(df.schema).option("header", True).csv(path)


register("report_csv", with_bindings(qr._report_sql() + qr.REPORT_SELECT), "SNK11 report metrics exported as CSV")(
    lambda b: _through_csv(b, rep.build_report(b.stored(), cov.coverage(b.stored(), b.stored().page_log), ALL, ORDER_AS_OF)[0])
)
register("comparison_csv", with_bindings(qm._comparison(ALL, ORDER_AS_OF_SQL)), "SNK12 comparison exported as CSV")(
    lambda b: _through_csv(b, kpis.comparison_kpis(b.stored(), ALL, ORDER_AS_OF))
)
