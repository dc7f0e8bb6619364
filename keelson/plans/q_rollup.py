"""Metrics of many windows from one stored rollup, folded in two batches (see :mod:`keelson.operators.rollup`).

The first batch is what was known at an instant: items that closed later are
still open in it. The second brings the items that came or changed since and
takes back the versions that it replaces.
"""

from __future__ import annotations

import hashlib
import inspect
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from keelson.functions.time import Window, ts_sql
from keelson.operators import rollup
from keelson.operators.tables import Tables
from keelson.plans import q_metrics as qm
from keelson.plans.catalog import (
    EVENT_AS_OF, EVENT_AS_OF_SQL, ORDER_AS_OF, ORDER_AS_OF_SQL, RECENT_180, RECENT_30_EVENTS, register,
)
from keelson.plans.oracle import with_bindings
from keelson.plans.q_windows import JANUARY, JANUARY_END, SPRING, SPRING_END
from keelson.schemas import KEYS
from keelson.session import scratch_path
from keelson.sources.warehouse import fingerprint

#: When the first batch was taken: of the items, and of the commits.
ITEMS_KNOWN, COMMITS_KNOWN = datetime(1998, 1, 1), datetime(2024, 1, 12)


def batches(t: Tables) -> list[tuple[Tables, Tables | None]]:
    """(rows that came, versions that they replace) of the two batches."""
    at, commits_at = ts_sql(ITEMS_KNOWN), ts_sql(COMMITS_KNOWN)
    later = f"closed_at >= {at}"

    def known(items):
        seen = {"state": F.expr(f"CASE WHEN {later} THEN 'open' ELSE state END")}
        for c in ("closed_at", "merged_at"):
            if c in items.columns:
                seen[c] = F.expr(f"CASE WHEN {later} THEN NULL ELSE {c} END")
        return items.where(f"created_at < {at}").withColumns(seen)

    def come(items):
        return items.where(f"created_at >= {at} OR {later}")

    first = replace(
        t, issues=known(t.issues), pull_requests=known(t.pull_requests), commits=t.commits.where(f"committed_at < {commits_at}")
    )
    second = replace(
        t, issues=come(t.issues), pull_requests=come(t.pull_requests), commits=t.commits.where(f"committed_at >= {commits_at}")
    )
    gone = replace(t, **{
        name: rollup.replaced(getattr(first, name), getattr(second, name), KEYS[name])
        for name in ("issues", "pull_requests", "commits")
    })
    return [(first, None), (second, gone)]


def stored_rollup(b) -> rollup.Rollup:
    """The rollup of a testdata folder; batches that it has already are not folded again."""
    code = hashlib.sha1((inspect.getsource(rollup) + inspect.getsource(batches)).encode()).hexdigest()[:8]
    state = rollup.Rollup(b.spark, scratch_path(b.spark, f"rollup-{fingerprint(b)}-{code}"))
    fresh = max(m.applied.get("batch", -1) for m in (state.items.manifest(), state.activity.manifest())) < 1
    for number, (added, removed) in enumerate(batches(b.stored())):
        if min(m.applied.get("batch", -1) for m in (state.items.manifest(), state.activity.manifest())) < number:
            state.fold(number, added, removed)
    if fresh:
        state.compact()
    return state


RECENT_30, RECENT_90 = (Window.trailing(days, ORDER_AS_OF) for days in (30, 90))

for _name, _window, _as_of, _sql in (
    ("30d", RECENT_30, ORDER_AS_OF, ORDER_AS_OF_SQL),
    ("90d", RECENT_90, ORDER_AS_OF, ORDER_AS_OF_SQL),
    ("180d", RECENT_180, ORDER_AS_OF, ORDER_AS_OF_SQL),
    ("dates", SPRING, ORDER_AS_OF, SPRING_END),
    ("30d_events", RECENT_30_EVENTS, EVENT_AS_OF, EVENT_AS_OF_SQL),
):
    register(
        f"rollup_comparison_{_name}",
        with_bindings(qm._comparison(_window, _sql)),
        "M3-M5, M16 comparison of a window from the rollup",
    )(lambda b, w=_window, at=_as_of: stored_rollup(b).comparison_kpis(b.stored(), w, at))

register(
    "rollup_issue_kpis_180d", with_bindings(qm._ITEM + qm._issues(RECENT_180, ORDER_AS_OF_SQL)), "M3 issue KPIs from the rollup"
)(lambda b: stored_rollup(b).issue_kpis(b.stored(), RECENT_180, ORDER_AS_OF))
register("rollup_pr_kpis_dates", with_bindings(qm._ITEM + qm._pulls(SPRING)), "M4 PR KPIs from the rollup")(
    lambda b: stored_rollup(b).pr_kpis(b.stored(), SPRING)
)
register(
    "rollup_contributor_kpis_dates",
    with_bindings(qm._per_author(JANUARY) + qm._contributors(JANUARY_END)),
    "M5 contributors from the rollup",
)(lambda b: stored_rollup(b).contributor_kpis(b.stored(), JANUARY, EVENT_AS_OF))
register("rollup_monthly_activity_dates", with_bindings(qm._monthly(SPRING)), "M6 monthly activity from the rollup")(
    lambda b: stored_rollup(b).monthly_activity(b.stored(), SPRING)
)
register(
    "rollup_top_contributors_dates", with_bindings(qm._per_author(SPRING) + qm._TOP), "M7 top contributors from the rollup"
)(lambda b: stored_rollup(b).top_contributors(b.stored(), SPRING, 12))
register(
    "rollup_contributor_retention_dates",
    with_bindings(qm._retention(SPRING) + "\nSELECT * FROM retention"),
    "M8 cohorts from the rollup",
)(lambda b: stored_rollup(b).contributor_retention(b.stored(), SPRING))
register("rollup_backlog_kpis_dates", with_bindings(qm._backlog(SPRING_END)), "M15 backlog from the rollup")(
    lambda b: stored_rollup(b).backlog_kpis(b.stored(), SPRING, ORDER_AS_OF)
)
