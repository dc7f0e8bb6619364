"""Hot keys: one repository with a third of all rows and one issue with thousands of
comments give the same first-response KPIs as a brute-force evaluation."""

from __future__ import annotations

import math
import random
from datetime import timedelta

import numpy as np

from keelson.functions.time import Window
from keelson.operators import kpis

from .conftest import ago, issue, make_tables


def _brute(issues, comments, repo):
    bots = ("dependabot", "github-actions")
    first = {}
    for r, n, _, a, t in comments:
        if r != repo or a is None or a.startswith(bots) or a.endswith("[bot]") or a == "codecov":
            continue
        first.setdefault(n, []).append((a, t))
    hours = []
    for r, n, _, author, _, created, _, _ in issues:
        if r != repo or author is None:
            continue
        ts = [t for a, t in first.get(n, []) if a != author]
        if ts:
            m = math.floor(min(ts).timestamp() / 60) - math.floor(created.timestamp() / 60)
            hours.append(m / 60.0)
    return len(hours), (float(np.median(hours)) if hours else None)


def test_hot_repository_and_hot_issue(spark):
    rnd = random.Random(11)
    issues, comments = [], []
    for n in range(1, 301):
        repo = "hot/repo" if n <= 100 else f"r{n % 7}/x"
        issues.append(issue(n, ago(50 + n % 30), author=f"u{n % 13}", repo=repo))
    cid = 0
    for _ in range(6000):  # a third of all comments land on one hot issue
        cid += 1
        comments.append(("hot/repo", 1, cid, rnd.choice(["u1", "codecov", "x[bot]", *[f"p{i}" for i in range(300)]]),
                         ago(49) + timedelta(minutes=rnd.randint(-600, 6000))))
    for _ in range(12000):
        cid += 1
        n = rnd.randint(1, 300)
        repo = "hot/repo" if n <= 100 else f"r{n % 7}/x"
        comments.append((repo, n, cid, rnd.choice([f"u{n % 13}", "dependabot", *[f"p{i}" for i in range(50)]]),
                         ago(49) + timedelta(minutes=rnd.randint(0, 9000))))
    repos = ("hot/repo", *{f"r{k}/x" for k in range(7)})
    t = make_tables(spark, repos=repos, issues=issues, comments=comments)
    got = {r["repo_full_name"]: r for r in kpis.issue_response_kpis(t, Window.all()).collect()}
    for repo in repos:
        n, med = _brute(issues, comments, repo)
        assert got[repo]["responded_issues"] == n, repo
        if med is None:
            assert got[repo]["median_first_response_hours"] is None
        else:
            assert abs(got[repo]["median_first_response_hours"] - med) <= 0.05 + 1e-9, repo
