"""Metrics of any window from one stored state by month, brought up to date by batches.

The state holds, of each repository and month,

* ``items``: a histogram of close (issues) or merge (PRs) hours with the counts
  of items in each state, and
* ``activity``: how much every author did, by type.

All of it is signed sums, so a batch is folded in by what it adds less what it
replaces, and nothing else is read: an issue that closes takes one from the open
ones of its month and adds one to the hours it took. A window is answered from
its whole months; only the months that an end of the window, or the instant from
which items count as stale, cuts in two are read from the entity tables. The
histogram gives exact quantiles, the authors' months exact distinct counts,
shares, rankings and cohorts.

Both tables are bucketed by their whole key, so a hot repository is spread; files
are listed with their least and greatest months, by which windows skip them.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.numeric import interpolated_quantiles
from keelson.functions.time import Window, ts_sql
from keelson.operators import kpis
from keelson.operators.author_months import months_of, retention
from keelson.operators.kpis import REPO, finish, merge_by_repo
from keelson.operators.tables import Tables
from keelson.sources.bucketed import BucketedTable

ITEM_KEY = [REPO, "kind", "month", "hours"]
ITEM_SUMS = ["n", "n_open", "n_closed", "n_closed_ready"]
ACTIVITY_KEY = [REPO, "month", "activity_type", "author"]
_MONTH_START = "make_timestamp(CAST(month div 12 AS INT), month % 12 + 1, 1, 0, 0, 0)"
BUCKETS = 16  # of each state table; a deployment sets them by its rows


def month_sql(column: str) -> str:
    """Months since year 0."""
    return f"CAST(year({column}) * 12 + month({column}) - 1 AS INT)"


def month_of(at: datetime) -> int:
    return at.year * 12 + at.month - 1


def start_of(month: int) -> datetime:
    return datetime(month // 12, month % 12 + 1, 1)


# --- windows as whole months and edges ----------------------------------------------------


@dataclass(frozen=True)
class Cover:
    """Ranges ``[first, after)`` of whole months (an end may be None) and windows for the rest."""

    months: tuple[tuple[int | None, int | None], ...]
    edges: tuple[Window, ...]


def cover(window: Window, *cuts: datetime) -> Cover:
    """``window`` in whole months and edges, so that no whole month holds one of ``cuts`` inside."""
    inner = sorted({c for c in cuts if (window.start is None or c > window.start) and (window.end is None or c < window.end)})
    ends = [window.start, *inner, window.end]
    months, edges = [], []
    for a, b in zip(ends, ends[1:]):
        first = None if a is None else month_of(a) + (a != start_of(month_of(a)))
        after = None if b is None else month_of(b)
        if first is not None and after is not None and first > after:
            edges.append(Window(a, b))  # within one month
            continue
        if a is not None and a != start_of(first):
            edges.append(Window(a, start_of(first)))
        if first is None or after is None or first < after:
            months.append((first, after))
        if b is not None and b != start_of(after):
            edges.append(Window(start_of(after), b))
    return Cover(tuple(months), tuple(e for e in edges if e.start != e.end))


def _any(conditions: list) -> F.Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _whole(state: BucketedTable, months: Sequence[tuple[int | None, int | None]]) -> DataFrame:
    """The state's rows of whole months; files of other months are not opened."""
    if not months:
        return state.read().where(F.lit(False))
    least = None if any(a is None for a, _ in months) else min(a for a, _ in months)
    most = None if any(b is None for _, b in months) else max(b for _, b in months) - 1
    inside = []
    for a, b in months:
        c = F.lit(True)
        if a is not None:
            c &= F.col("month") >= a
        if b is not None:
            c &= F.col("month") < b
        inside.append(c)
    return state.read({"month": (least, most)}).where(_any(inside))


# --- state of entity rows -----------------------------------------------------------------


def items_state(tables, edges: Sequence[Window] | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Histogram rows of issues and PRs, of ``edges`` only where given.

    ``extra`` names more columns of the items to keep apart by (``created_at``).
    """
    known = F.col("created_at").isNotNull() if edges is None else _any([e.contains("created_at") for e in edges])
    cols = ["state", *extra]
    issues = tables.issues.where(known).selectExpr(
        REPO, "'issue' AS kind", f"{month_sql('created_at')} AS month",
        f"CASE WHEN closed_at IS NOT NULL THEN {kpis._hours_sql('created_at', 'closed_at')} END AS hours",
        "false AS ready_closed", *cols,
    )
    prs = tables.pull_requests.where(known).selectExpr(
        REPO, "'pr' AS kind", f"{month_sql('created_at')} AS month",
        f"CASE WHEN merged_at IS NOT NULL THEN {kpis._hours_sql('created_at', 'merged_at')} END AS hours",
        "NOT draft AND closed_at IS NOT NULL AS ready_closed", *cols,
    )
    return issues.unionByName(prs).groupBy(*ITEM_KEY, *extra).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("count_if(state = 'open') AS n_open"),
        F.expr("count_if(state = 'closed') AS n_closed"),
        F.expr("count_if(ready_closed) AS n_closed_ready"),
    )


def activity_state(tables, edges: Sequence[Window] | None = None) -> DataFrame:
    """What every author did by month and type, of ``edges`` only where given; issues count without authors."""

    def known(at: str):
        return F.col(at).isNotNull() if edges is None else _any([e.contains(at) for e in edges])

    def rows(df: DataFrame, at: str, kind: str, author: str) -> DataFrame:
        return df.where(known(at)).selectExpr(REPO, f"{month_sql(at)} AS month", f"'{kind}' AS activity_type", f"{author} AS author", at + " AS at")

    every = (
        rows(tables.issues, "created_at", "Issue", "CAST(NULL AS STRING)")
        .unionByName(rows(tables.pull_requests, "created_at", "PR", "author"))
        .unionByName(rows(tables.commits, "committed_at", "Commit", "author"))
    )
    return every.groupBy(*ACTIVITY_KEY).agg(F.count(F.lit(1)).alias("n"))


def difference(added: DataFrame, removed: DataFrame | None, key: list[str], sums: list[str]) -> DataFrame:
    """``added`` less ``removed``, without the rows where nothing changed."""
    if removed is not None:
        added = added.unionByName(removed.select(*key, *[(-F.col(c)).alias(c) for c in sums]))
        added = added.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])
    return added.where(_any([F.col(c) != 0 for c in sums]))


def replaced(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored versions that the rows of ``batch`` take the place of."""
    return stored.join(batch.select(*keys).distinct(), list(keys), "left_semi")


class Rollup:
    """The stored state under ``path``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.items = BucketedTable(spark, os.path.join(path, "items"), stats=["month"])
        self.activity = BucketedTable(spark, os.path.join(path, "activity"), stats=["month"])
        sums = ", ".join(f"{c} long" for c in ITEM_SUMS)
        layouts = (
            (self.items, ITEM_KEY, f"{REPO} string, kind string, month int, hours double, {sums}, batch long"),
            (self.activity, ACTIVITY_KEY, f"{REPO} string, month int, activity_type string, author string, n long, batch long"),
        )
        for table, key, ddl in layouts:
            # one row of each key and batch: readers add the batches up
            table.create(spark.createDataFrame([], ddl).schema, [*key, "batch"], ["batch"], buckets)

    def fold(self, batch: int, added: Tables, removed: Tables | None = None) -> None:
        """Fold in batch number ``batch``: entity rows that came and the versions that they replace.

        A batch that was folded before changes nothing, whichever of the two
        tables it had reached when it was interrupted.
        """
        for table, state, key, sums in (
            (self.items, items_state, ITEM_KEY, ITEM_SUMS), (self.activity, activity_state, ACTIVITY_KEY, ["n"]),
        ):
            delta = difference(state(added), None if removed is None else state(removed), key, sums)
            table.upsert(delta.withColumn("batch", F.lit(batch).cast("long")), batch)

    def compact(self) -> None:
        self.items.compact()
        self.activity.compact()

    # --- parts: one row per repository, named as the metrics name them -------------------

    def _items(self, tables, kind: str, window: Window, stale_before: datetime | None = None) -> DataFrame:
        """(repository, hours, sums, n_stale) of a window; ``n_stale``: open items from before that instant."""
        c = cover(window, *([stale_before] if stale_before else []))
        old_month = f"month < {month_of(stale_before)}" if stale_before else "false"
        whole = _whole(self.items, c.months).where(F.col("kind") == kind).selectExpr(
            REPO, "hours", *ITEM_SUMS, f"CASE WHEN {old_month} THEN n_open ELSE 0L END AS n_stale"
        )
        rows = whole
        if c.edges:
            old = f"created_at < {ts_sql(stale_before)}" if stale_before else "false"
            edge = items_state(tables, c.edges, ["created_at"]).where(F.col("kind") == kind)
            rows = whole.unionByName(edge.selectExpr(REPO, "hours", *ITEM_SUMS, f"CASE WHEN {old} THEN n_open ELSE 0L END AS n_stale"))
        sums = [*ITEM_SUMS, "n_stale"]
        return rows.groupBy(REPO, "hours").agg(*[F.sum(s).alias(s) for s in sums]).where("n <> 0")

    def issue_parts(self, tables, window: Window, as_of: datetime, x: str = "i_") -> list[DataFrame]:
        stale = window.end_or(as_of) - timedelta(days=90)
        return [interpolated_quantiles(
            self._items(tables, "issue", window, stale), [REPO], "hours", {f"{x}median": 0.5, f"{x}p90": 0.9},
            rows_as=f"{x}total", counts_if={f"{x}open": "n_open", f"{x}closed": "n_closed", f"{x}stale": "n_stale"}, weight="n",
        )]

    def pr_parts(self, tables, window: Window, x: str = "p_") -> list[DataFrame]:
        return [interpolated_quantiles(
            self._items(tables, "pr", window), [REPO], "hours", {f"{x}median": 0.5, f"{x}p90": 0.9},
            values_as=f"{x}merged", rows_as=f"{x}total",
            counts_if={f"{x}open": "n_open", f"{x}closed_nd": "n_closed_ready"}, weight="n",
        )]

    def _activity(self, tables, window: Window, recent_from: datetime | None = None) -> DataFrame:
        """(repository, month, type, author, n, n_recent) of a window; ``n_recent``: from that instant on."""
        c = cover(window, *([recent_from] if recent_from else []))
        new_month = f"month >= {month_of(recent_from)}" if recent_from else "false"
        rows = _whole(self.activity, c.months).selectExpr(*ACTIVITY_KEY, "n", f"CASE WHEN {new_month} THEN n ELSE 0L END AS n_recent")
        for e in c.edges:  # each edge lies on one side of the instant
            recent = recent_from is not None and e.start is not None and e.start >= recent_from
            rows = rows.unionByName(activity_state(tables, [e]).selectExpr(*ACTIVITY_KEY, "n", f"{'n' if recent else '0L'} AS n_recent"))
        sums = rows.groupBy(*ACTIVITY_KEY).agg(F.sum("n").alias("n"), F.sum("n_recent").alias("n_recent"))
        return sums.where("n <> 0")

    def contributor_parts(self, tables, window: Window, as_of: datetime, x: str = "c_") -> list[DataFrame]:
        recent = window.end_or(as_of) - timedelta(days=90)
        per_author = (
            self._activity(tables, window, recent).where("author IS NOT NULL AND activity_type <> 'Issue'")
            .groupBy(REPO, "author").agg(F.sum("n").alias("events"), F.sum("n_recent").alias("recent"))
        )
        return [kpis._agg(
            per_author, f"count(1) AS {x}contributors", f"count_if(recent > 0) AS {x}active",
            f"max(events) AS {x}max_events", f"sum(events) AS {x}sum_events",
        )]

    # --- metrics, as keelson.operators.kpis returns them -----------------------------------

    def issue_kpis(self, tables, window: Window, as_of: datetime) -> DataFrame:
        return finish(merge_by_repo([kpis._repos(tables), *self.issue_parts(tables, window, as_of)]), kpis._issue_cols())

    def pr_kpis(self, tables, window: Window) -> DataFrame:
        return finish(merge_by_repo([kpis._repos(tables), *self.pr_parts(tables, window)]), kpis._pr_cols())

    def contributor_kpis(self, tables, window: Window, as_of: datetime) -> DataFrame:
        parts = self.contributor_parts(tables, window, as_of)
        return finish(merge_by_repo([kpis._repos(tables), *parts]), kpis._contributor_cols())

    def backlog_kpis(self, tables, window: Window, as_of: datetime) -> DataFrame:
        """Open items of each age at the window's end: three windows that differ in their ends."""
        end, x = window.end_or(as_of), "b_"
        ends = {"": end, "30": end - timedelta(days=30), "90": end - timedelta(days=90)}
        c = cover(Window(None, end), *ends.values())

        sums = [
            f"sum(CASE WHEN kind = '{kind}' AND at < {ts_sql(at)} THEN n_open ELSE 0L END) AS "
            + (f"{x}{kind}_stale_{age}" if age else f"{x}open_{kind}s")
            for kind in ("issue", "pr") for age, at in ends.items()
        ]
        whole = _whole(self.items, c.months).selectExpr(REPO, "kind", "n_open", f"{_MONTH_START} AS at")
        edge = items_state(tables, c.edges, ["created_at"]).selectExpr(REPO, "kind", "n_open", "created_at AS at")
        return finish(merge_by_repo([kpis._repos(tables), kpis._agg(whole.unionByName(edge), *sums)]), kpis._backlog_cols(x))

    def monthly_activity(self, tables, window: Window) -> DataFrame:
        months = self._activity(tables, window).groupBy(REPO, "month", "activity_type").agg(F.sum("n").alias("activity_count"))
        return months.selectExpr(REPO, f"{_MONTH_START} AS month", "activity_type", "activity_count")

    def top_contributors(self, tables, window: Window, limit: int = 12) -> DataFrame:
        per_author = self._activity(tables, window).where("author IS NOT NULL AND activity_type <> 'Issue'").groupBy(REPO, "author").agg(
            F.expr("sum(CASE WHEN activity_type = 'Commit' THEN n ELSE 0L END) AS commits"),
            F.expr("sum(CASE WHEN activity_type = 'PR' THEN n ELSE 0L END) AS pull_requests"),
            F.sum("n").alias("total_activity"),
        )
        w = W.partitionBy(REPO).orderBy(F.desc("total_activity"), F.asc_nulls_last("author"))
        ranked = per_author.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
        return ranked.select(REPO, "rank", "author", "commits", "pull_requests", "total_activity")

    def contributor_retention(self, tables, window: Window) -> DataFrame:
        """Cohorts from the months in which authors did anything."""
        rows = self._activity(tables, window).where("author IS NOT NULL AND activity_type <> 'Issue'")
        return kpis.with_retention_rate(retention(months_of(rows.selectExpr(REPO, "author", f"{_MONTH_START} AS occurred_at"))))

    def comparison_kpis(self, tables, window: Window, as_of: datetime) -> DataFrame:
        return kpis.compared([
            tables.repositories.select(REPO, "language", "stars"), *self.issue_parts(tables, window, as_of),
            *self.pr_parts(tables, window), *self.contributor_parts(tables, window, as_of),
        ])

