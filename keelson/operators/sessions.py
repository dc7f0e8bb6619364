"""Collection runs found in the page log itself: sessions of fetch times, page numbers, lost pages.

A log that doesn't carry run ids still shows its runs: fetches of a repository
less than ``GAP`` apart belong together, whatever the calendar says, so two runs
a day and a run across midnight come out right.

* Sessions: pages are first counted by minute (a partial aggregate), so
  ``session_window`` merges at most one row a minute for each repository.
* Page numbers within (run, entity): prefix sums over sorted ranges
  (:func:`keelson.operators.ranking.ranked`).
* Lost pages: islands of consecutive feed page numbers. A page begins an island
  when the number before it is missing, found by an anti-join; only islands, not
  pages, meet in a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators.coverage import page_limit_hit
from keelson.operators.kpis import REPO
from keelson.operators.ranking import ranked

#: Minutes without a fetch that end a run; at least one, the width of the counted slots.
GAP_MINUTES = 45


def sessions(pages: DataFrame, gap_minutes: int = GAP_MINUTES, time: str = "fetched_at") -> DataFrame:
    """(repository, run_started_at, run_ended_at, pages, minutes): every run of every repository, its minutes listed."""
    minute = F.date_trunc("minute", F.col(time))
    slots = pages.groupBy(REPO, minute.alias("minute")).agg(
        F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("n")
    )
    # a microsecond less: session windows that only touch are one session
    span = "cast((unix_micros(last_at) - unix_micros(first_at) - 1) / 1000000 as decimal(18, 6))"
    reach = F.expr(f"make_interval(0, 0, 0, 0, 0, {gap_minutes}, {span})")
    run = F.session_window("first_at", reach)
    return slots.groupBy(REPO, run.alias("run")).agg(
        F.min("first_at").alias("run_started_at"), F.max("last_at").alias("run_ended_at"),
        F.sum("n").alias("pages"), F.collect_list("minute").alias("minutes"),
    ).drop("run")


def with_runs(pages: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """``pages`` with ``run_started_at`` and ``run_ended_at`` of their run: a minute lies in one run only."""
    slots = sessions(pages, gap_minutes).select(
        REPO, "run_started_at", "run_ended_at", F.explode("minutes").alias("_minute")
    )
    return pages.withColumn("_minute", F.date_trunc("minute", "fetched_at")).join(slots, [REPO, "_minute"]).drop("_minute")


def numbered_pages(pages: DataFrame, max_pages: int, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Pages with their run, their number in (run, entity) from 1, and whether that is a full page at the limit (INC6)."""
    runs = with_runs(pages, gap_minutes)
    placed = ranked(runs, [REPO, "run_started_at", "entity_type"], ["fetched_at", "page_no"], "_before")
    placed = placed.withColumn("page", F.col("_before") + 1).drop("_before")
    return placed.withColumn("limit_hit", page_limit_hit("page", "items", max_pages))


def run_summary(numbered: DataFrame) -> DataFrame:
    """One row per run and entity: pages, items, whether its limit page came back full."""
    return numbered.groupBy(REPO, "run_started_at", "run_ended_at", "entity_type").agg(
        F.count("*").alias("pages"), F.sum("items").cast("long").alias("items"), F.bool_or("limit_hit").alias("truncated")
    )


def lost_pages(numbered: DataFrame) -> DataFrame:
    """Ranges of feed page numbers that no run has, with the run that first went on behind them.

    What is lost behind the last page can't be known from the log.
    """
    key = [REPO, "entity_type"]
    have = numbered.select(*key, "page_no")
    starts = numbered.select(*key, "page_no", "run_started_at").join(
        have.select(*key, (F.col("page_no") + 1).alias("page_no")), [*key, "page_no"], "left_anti"
    )
    ends = have.join(have.select(*key, (F.col("page_no") - 1).alias("page_no")), [*key, "page_no"], "left_anti")
    edges = starts.select(*key, F.col("page_no").alias("start"), F.lit(None).cast("long").alias("end"), "run_started_at").unionByName(
        ends.select(*key, F.lit(None).cast("long").alias("start"), F.col("page_no").alias("end"), F.lit(None).cast("timestamp").alias("run_started_at"))
    )
    before = W.partitionBy(*key).orderBy(F.coalesce("start", "end"), F.col("start").isNull()).rowsBetween(W.unboundedPreceding, -1)
    gaps = edges.withColumn("known", F.coalesce(F.max("end").over(before), F.lit(0))).where("start > known + 1")
    return gaps.select(
        *key, "run_started_at", (F.col("known") + 1).alias("first_lost"), (F.col("start") - 1).alias("last_lost"),
        (F.col("start") - F.col("known") - 1).alias("n_lost"),
    )
