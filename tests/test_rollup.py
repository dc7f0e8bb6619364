"""Metrics from the monthly rollup equal those of the entity rows, for any window and after any batches."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from keelson.functions.time import Window
from keelson.operators import kpis
from keelson.operators.rollup import Rollup, cover, month_of, replaced, start_of
from keelson.schemas import KEYS

from .conftest import issue, make_tables, pr

AS_OF = datetime(2025, 7, 20, 6)
WINDOWS = [
    Window.trailing(90, AS_OF),
    Window.dates(datetime(2025, 2, 5), datetime(2025, 2, 9)),
    Window(datetime(2025, 1, 1), datetime(2025, 6, 1)),
    Window(None, datetime(2025, 5, 3, 1)),
]


def world(seed):
    rng = random.Random(seed)

    def at():
        edge = rng.choice([datetime(2025, m, 1) for m in (1, 2, 3, 4, 5, 6)])
        return rng.choice([edge, edge - timedelta(microseconds=1), edge + timedelta(minutes=rng.randint(0, 40_000))])

    def items(make, **more):
        out = []
        for n in range(160):
            created = at()
            done = created + timedelta(minutes=rng.randint(0, 90_000)) if rng.random() < 0.6 else None
            repo = rng.choice(["o/hot", "o/hot", "o/a", "o/b"])
            out.append(make(n, created, rng.choice(["u", "v", "w", None]), done, repo, rng))
        return out

    issues = items(lambda n, c, a, d, r, g: issue(n, c, a, "closed" if d else "open", d, r))
    prs = items(lambda n, c, a, d, r, g: pr(
        n, c, a, "closed" if d else "open", g.random() < 0.2, d, d if d and g.random() < 0.7 else None, r))
    commits = [(rng.choice(["o/hot", "o/a"]), f"s{i}", rng.choice(["u", "v", "x", None]), at()) for i in range(150)]
    return dict(repos=("o/hot", "o/a", "o/b", "o/empty"), issues=issues, prs=prs, commits=commits)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def agree(state, t, window):
    for got, want in (
        (state.issue_kpis(t, window, AS_OF), kpis.issue_kpis(t, window, AS_OF)),
        (state.pr_kpis(t, window), kpis.pr_kpis(t, window)),
        (state.contributor_kpis(t, window, AS_OF), kpis.contributor_kpis(t, window, AS_OF)),
        (state.backlog_kpis(t, window, AS_OF), kpis.backlog_kpis(t, window, AS_OF)),
        (state.monthly_activity(t, window), kpis.monthly_activity(t, window)),
    ):
        assert got.columns == want.columns
        assert found(got) == found(want)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    t = make_tables(spark, **world(1))
    state = Rollup(spark, str(tmp_path_factory.mktemp("rollup")), buckets=2)
    state.fold(0, t)
    state.compact()
    return state, t


@pytest.mark.parametrize("window", WINDOWS, ids=str)
def test_windows_match_the_entity_rows(loaded, window):
    agree(*loaded, window)


def test_a_batch_takes_back_what_it_replaces_and_counts_once(spark, tmp_path):
    old, new = world(2), world(3)
    before, batch = make_tables(spark, **old), make_tables(spark, **new)
    names = ("issues", "pull_requests", "commits")
    gone = replace(before, **{n: replaced(getattr(before, n), getattr(batch, n), KEYS[n]) for n in names})
    state = Rollup(spark, str(tmp_path), buckets=2)
    state.fold(0, before)
    state.fold(1, batch, gone)
    version = state.items.manifest().version
    state.fold(1, batch, gone)  # a replay
    assert state.items.manifest().version == version
    kept = {
        n: getattr(before, n).join(getattr(batch, n).select(*KEYS[n]), list(KEYS[n]), "left_anti").unionByName(getattr(batch, n))
        for n in names
    }
    agree(state, replace(before, **kept), Window.dates(datetime(2025, 1, 15), datetime(2025, 5, 20)))


def test_an_empty_rollup_and_only_some_files(loaded, spark, tmp_path):
    empty = make_tables(spark)
    agree(Rollup(spark, str(tmp_path), buckets=2), empty, Window.trailing(90, AS_OF))
    state, _ = loaded
    march = month_of(datetime(2030, 3, 1))
    assert state.items.files_for() and not state.items.files_for({"month": (march, march)})


def test_cover_is_the_window_and_whole_months_hold_no_cut():
    rng = random.Random(5)

    def instant():
        return rng.choice([start_of(24_300 + rng.randint(0, 5)), datetime(2025, 1, 1) + timedelta(hours=rng.randint(0, 4_000))])

    for _ in range(400):
        a, b = sorted((instant(), instant()))
        window = Window(rng.choice([a, None]), rng.choice([b, None]))
        cut = instant()
        c = cover(window, cut)
        for first, after in c.months:
            inside = (first is None or start_of(first) < cut) and (after is None or cut < start_of(after))
            assert not inside
        for _ in range(40):
            x = instant()
            whole = sum((f is None or month_of(x) >= f) and (n is None or month_of(x) < n) for f, n in c.months)
            edge = sum(e.start <= x < e.end for e in c.edges)
            assert whole + edge == ((window.start is None or x >= window.start) and (window.end is None or x < window.end))
