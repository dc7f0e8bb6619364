"""Bind the generated testdata tables to the repository-health entities.

The mapping (orders -> issues / pull requests, lineitem -> comments / reviews,
events -> commits / releases / runs / page log) is fixed by FIXTURES.md §4 and
is reproduced exactly by the DuckDB oracle text in :mod:`keelson.plans.oracle`.
Every entity is a lazy DataFrame over the parquet scan, so Catalyst prunes
columns and pushes filters into the scan for each metric separately.
"""

from __future__ import annotations

import os
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.coverage import page_limit_hit
from keelson.operators.ranking import ranked
from keelson.operators.upsert import keep_last

# Reference instants for the two families of bound entities.
ORDER_AS_OF = datetime(2001, 8, 1)
EVENT_AS_OF = datetime(2024, 1, 31)

# Which entity a page-log event type stands for (six entities,
# five event types; pr_reviews has no pages in the bound page log).
PAGE_ENTITY = {
    "view": "issues",
    "click": "pull_requests",
    "purchase": "commits",
    "signup": "releases",
    "error": "issue_comments",
}

# Entity order used by coverage and quality flags.
ENTITY_ORDER = ("issues", "pull_requests", "commits", "releases", "issue_comments", "pr_reviews")


def _plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * F.lit(1_000_000))


def _utc(column: str) -> Column:
    """testdata timestamps are ``timestamp_ntz``; entities use UTC ``timestamp``."""
    return F.col(column).cast("timestamp")


def _event_author() -> Column:
    """Who wrote an event, by its supplier."""
    supp = F.col("supplier")
    s = supp.cast("string")
    return (
        F.when(supp % 10 == 0, F.concat(F.lit("svc"), s, F.lit("[bot]")))
        .when(supp % 10 == 1, F.lit("codecov"))
        .when(supp % 10 == 2, F.concat(F.lit("dependabot-"), s))
        .otherwise(F.concat(F.lit("u"), s))
        .alias("author")
    )


@dataclass
class Bindings:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    # --- dimensions ---------------------------------------------------------------

    @cached_property
    def repo_dim(self) -> DataFrame:
        region = self.table("region").select("r_regionkey", "r_name")
        nation = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey",
            F.concat("r_name", F.lit("/"), "n_name").alias("repo_full_name"),
            "r_name",
        )

    @cached_property
    def repositories(self) -> DataFrame:
        d = self.repo_dim
        return d.select(
            "repo_full_name",
            F.lit(None).cast("string").alias("description"),
            (F.col("n_nationkey") * 100).alias("stars"),
            (F.col("n_nationkey") * 10).alias("forks"),
            F.lit(0).alias("watchers"),
            F.lit(0).alias("open_issues"),
            F.lit(None).cast("string").alias("default_branch"),
            F.col("r_name").alias("language"),
            F.lit(None).cast("string").alias("license_name"),
            _plus_seconds(
                F.lit("2001-07-29 00:00:00").cast("timestamp"), F.col("n_nationkey") * 4 * 3600
            ).alias("fetched_at"),
        )

    # --- items (orders) -------------------------------------------------------------

    @cached_property
    def _items(self) -> DataFrame:
        orders = (
            self.table("orders").select(
                "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
            )
        )
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        number = F.col("o_orderkey")
        created = _plus_seconds(_utc("o_orderdate"), (number * 7919) % 86400)
        items = (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(self.repo_dim, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "repo_full_name",
                number.alias("number"),
                "o_orderpriority",
                F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("author"),
                F.col("o_orderpriority").alias("title"),
                created.alias("created_at"),
                F.col("o_orderstatus"),
            )
        )
        finished = F.col("o_orderstatus") == "F"
        closed_at = F.when(
            finished,
            _plus_seconds(F.col("created_at"), ((F.col("number") * 104729) % 108000) * 60),
        )
        return items.select(
            "*",
            F.when(finished, "closed").otherwise("open").alias("state"),
            closed_at.alias("closed_at"),
        )

    @cached_property
    def issues(self) -> DataFrame:
        i = self._items.where(F.col("o_orderpriority") >= "3")
        return i.select(
            "repo_full_name",
            F.col("number").alias("issue_number"),
            "state",
            "author",
            "title",
            F.lit("[]").alias("labels_json"),
            F.lit(0).alias("comments"),
            F.lit(False).alias("locked"),
            "created_at",
            F.coalesce("closed_at", "created_at").alias("updated_at"),
            "closed_at",
        )

    @cached_property
    def pull_requests(self) -> DataFrame:
        p = self._items.where(F.col("o_orderpriority") < "3")
        return p.select(
            "repo_full_name",
            F.col("number").alias("pr_number"),
            "state",
            "author",
            "title",
            ((F.col("number") % 17) == 0).alias("draft"),
            F.lit(0).alias("comments"),
            F.lit(0).alias("review_comments"),
            "created_at",
            F.coalesce("closed_at", "created_at").alias("updated_at"),
            "closed_at",
            F.when((F.col("number") % 4) != 0, F.col("closed_at")).alias("merged_at"),
            F.lit(None).cast("string").alias("merge_commit_sha"),
        )

    # --- item events (lineitem) -----------------------------------------------------

    @cached_property
    def item_events(self) -> DataFrame:
        """One event per id: of line items that share a key the last arrival counts."""
        last = keep_last(self._event_rows, ["event_id"], ["arrival_seq"])
        return last.select("event_id", "number", "l_linenumber", _event_author(), "created_at", "arrival_seq")

    @cached_property
    def item_event_versions(self) -> DataFrame:
        return self._event_rows.select("number", "l_linenumber", "event_id", _event_author(), "created_at", "arrival_seq")

    @cached_property
    def _event_rows(self) -> DataFrame:
        """Line items as events whose columns all have a fixed width, by which versions are told apart without sorting."""
        li = (
            self.table("lineitem").select(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"
            )
        )
        return li.select(
            F.col("l_orderkey").alias("number"),
            "l_linenumber",
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
            F.col("l_suppkey").alias("supplier"),
            _plus_seconds(_utc("l_shipdate"), (F.col("l_partkey") * 31) % 86400).alias(
                "created_at"
            ),
        ).withColumn("arrival_seq", F.unix_seconds("created_at") * 10_000_000 + F.col("supplier"))

    @cached_property
    def _placed_events(self) -> DataFrame:
        """Events with the repository of their item, and whether that is an issue (else a pull request; null: neither)."""
        items = self._items.select("repo_full_name", "number", (F.col("o_orderpriority") >= "3").alias("of_issue"))
        return self.item_events.select("event_id", "number", "author", "created_at").join(items, "number")

    def events_for(self, items: DataFrame, number_col: str, events: DataFrame) -> DataFrame:
        keys = items.select("repo_full_name", F.col(number_col).alias("number"))
        return events.join(keys, "number")

    @cached_property
    def issue_comments(self) -> DataFrame:
        e = self._placed_events.where("of_issue")
        return e.select(
            "repo_full_name",
            F.col("number").alias("issue_number"),
            F.col("event_id").alias("comment_id"),
            "author",
            F.lit(None).cast("string").alias("body"),
            "created_at",
        )

    @cached_property
    def pr_reviews(self) -> DataFrame:
        e = self._placed_events.where("NOT of_issue")
        return e.select(
            "repo_full_name",
            F.col("number").alias("pr_number"),
            F.col("event_id").alias("review_id"),
            "author",
            F.lit("COMMENTED").alias("state"),
            F.lit(None).cast("string").alias("body"),
            F.col("created_at").alias("submitted_at"),
        )

    # --- events -----------------------------------------------------------------------

    @cached_property
    def _ev(self) -> DataFrame:
        return self.events_with_repo((self.table("events")))

    def events_with_repo(self, events: DataFrame) -> DataFrame:
        """Attach the repository to raw events (batch or streaming) via the
        static customer and repository dimensions."""
        events = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            events.join(customer, events.user_id == customer.c_custkey)
            .join(self.repo_dim, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "repo_full_name",
                "event_id",
                _utc("ts").alias("ts"),
                "user_id",
                "event_type",
                "value",
                "props",
            )
        )

    @cached_property
    def commits(self) -> DataFrame:
        return self._ev.select(
            "repo_full_name",
            F.col("event_id").cast("string").alias("sha"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
            F.lit(None).cast("string").alias("message"),
            F.col("ts").alias("authored_at"),
            F.col("ts").alias("committed_at"),
        )

    @cached_property
    def releases(self) -> DataFrame:
        r = self._ev.where(F.col("event_type") == "purchase")
        return r.select(
            "repo_full_name",
            F.col("event_id").alias("release_id"),
            F.lit(None).cast("string").alias("tag_name"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("author"),
            (F.col("value") < 2).alias("draft"),
            F.lit(False).alias("prerelease"),
            F.col("ts").alias("created_at"),
            F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("published_at"),
        )

    @cached_property
    def pipeline_runs(self) -> DataFrame:
        et = F.col("event_type")
        status = F.when(et == "error", "failed").when(et == "view", "running").otherwise("success")
        zero = F.lit(0)
        return self._ev.select(
            F.col("event_id").cast("string").alias("run_id"),
            "repo_full_name",
            F.col("ts").alias("started_at"),
            F.lit(None).cast("timestamp").alias("finished_at"),
            status.alias("status"),
            zero.alias("issues_loaded"),
            zero.alias("pull_requests_loaded"),
            zero.alias("commits_loaded"),
            zero.alias("releases_loaded"),
            zero.alias("issue_comments_loaded"),
            zero.alias("pr_reviews_loaded"),
            zero.alias("max_pages"),
            F.lit(False).alias("is_incremental"),
            F.when(et == "error", F.col("props")).alias("error_message"),
        )

    @cached_property
    def page_log(self) -> DataFrame:
        """One row per fetched page: (repo, entity, run day, sequence, item count,
        whether the page hit the pagination limit). In the bound log every full
        page counts as the limit page."""
        mapping = F.create_map(*[F.lit(x) for kv in PAGE_ENTITY.items() for x in kv])
        return self._ev.select(
            "repo_full_name",
            F.col("event_type").alias("event_type"),
            mapping[F.col("event_type")].alias("entity_type"),
            F.to_date("ts").alias("run_day"),
            F.col("event_id").alias("page_seq"),
            F.when(F.col("value") > 60, 100).otherwise(40).alias("items"),
            F.col("ts").alias("fetched_at"),
        ).withColumn("limit_hit", F.col("items") == 100)


    @cached_property
    def run_pages(self) -> DataFrame:
        """A page log by run: runs of each half day, each with its page limit; one page in 200 is full.

        Pages of an entity are numbered in fetch order; where a half day has more
        than the limit, the next run goes on, so every page is in one run.
        """
        day = F.to_date("ts")
        half = F.when(F.hour("ts") < 12, "a").otherwise("b")
        comments = F.when(F.col("event_id") % 2 == 0, "issue_comments").otherwise("pr_reviews")
        names = F.create_map(*[F.lit(x) for kv in PAGE_ENTITY.items() if kv[0] != "error" for x in kv])
        turn = F.dayofmonth("ts") % 3
        pages = self._ev.select(
            "repo_full_name",
            F.concat(day.cast("string"), half).alias("run_id"),
            F.when(F.col("event_type") == "error", comments).otherwise(names[F.col("event_type")]).alias("entity_type"),
            "event_id",
            F.when(F.col("event_id") % 200 == 0, 100).otherwise(40).alias("items"),
            F.when(turn == 0, 2).when(turn == 1, 8).otherwise(30).alias("max_pages"),
            F.col("ts").alias("fetched_at"),
        )
        placed = ranked(pages, ["repo_full_name", "run_id", "entity_type"], ["event_id"], "before")
        nth = F.floor(F.col("before") / F.col("max_pages")).cast("int")
        later = F.format_string("%s.%06d", F.col("run_id"), nth)
        numbered = placed.withColumns(
            {"run_id": F.when(nth > 0, later).otherwise(F.col("run_id")), "page": F.col("before") % F.col("max_pages") + 1}
        )
        return numbered.withColumn("limit_hit", page_limit_hit("page", "items", "max_pages")).drop("event_id", "before")

    @cached_property
    def feed_pages(self) -> DataFrame:
        """A page log without run ids: pages of each feed numbered in fetch order, one in 97 lost."""
        pages = self.page_log.select("repo_full_name", "entity_type", "page_seq", "items", "fetched_at")
        placed = ranked(pages, ["repo_full_name", "entity_type"], ["fetched_at", "page_seq"], "before")
        kept = placed.where("page_seq % 97 <> 0")
        return kept.select("repo_full_name", "entity_type", (F.col("before") + 1).alias("page_no"), "items", "fetched_at")

    @contextmanager
    def shared_inputs(self):
        """Persist the three joins every bound entity derives from (orders with
        their repository, events with their repository, line items with their
        order) while several entities are written, then release them. Lost cached
        blocks are recomputed from lineage, so this is safe under executor loss."""
        shared = [self._items, self._ev, self._placed_events]
        for df in shared:
            df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield self
        finally:
            for df in shared:
                df.unpersist()

    def stored(self):
        """The entity tables materialised as Parquet (see :mod:`keelson.sources.warehouse`)."""
        if "_stored" not in self.__dict__:
            from keelson.sources.warehouse import stored_tables

            self.__dict__["_stored"] = stored_tables(self)
        return self.__dict__["_stored"]

