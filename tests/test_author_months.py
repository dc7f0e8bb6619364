"""Month bits of authors against brute force; states merge to the same as one pass."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keelson.operators import author_months as am

ROWS = "repo_full_name string, author string, occurred_at timestamp"


def activity(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(900):
        month = rng.choice([0, 1, 2, 11, 12, 13, 31, 32, 33, 40, 63, 64, 65, 100]) + rng.choice([0, 0, 0, 1])
        at = datetime(1999 + month // 12, month % 12 + 1, rng.randint(1, 28), rng.randint(0, 23))
        out.append((f"o/{rng.randint(0, 2)}", f"u{rng.randint(0, 60)}", at))
    return out


def brute(rows):
    months = defaultdict(set)
    for repo, author, at in rows:
        months[repo, author].add(at.year * 12 + at.month - 1)
    cells, sizes = Counter(), Counter()
    for (repo, _), ms in months.items():
        first = min(ms)
        sizes[repo, first] += 1
        for m in ms:
            if m - first <= 12:
                cells[repo, first, m - first] += 1
    return sorted((repo, datetime(c // 12, c % 12 + 1, 1), k, sizes[repo, c], n) for (repo, c, k), n in cells.items())


def found(state):
    cols = (am.REPO, "cohort_month", "month_number", "cohort_size", "active_contributors")
    return sorted(tuple(r[c] for c in cols) for r in am.retention(state).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_retention_matches_brute_force(spark, seed):
    rows = activity(seed)
    assert found(am.months_of(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_states_of_batches_merge(spark):
    rows = activity(3)
    parts = [am.months_of(spark.createDataFrame(rows[i::3], ROWS)) for i in range(3)]
    once, twice = am.merged(*parts), am.merged(am.merged(*parts[:2]), parts[2], parts[0])
    assert found(once) == found(twice) == brute(rows)
    whole = am.months_of(spark.createDataFrame(rows, ROWS))
    assert once.exceptAll(whole).count() == 0 and whole.exceptAll(once).count() == 0


def test_no_window_and_no_distinct(spark):
    df = spark.createDataFrame(activity(4), ROWS)
    plan = am.retention(am.months_of(df))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan
    assert found(am.months_of(df.where(F.lit(False)))) == []
