"""The page log by run holds every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import coverage as cov
from keelson.sources.bindings import Bindings

from .conftest import SF, ago, make_tables


def test_every_page_is_in_one_run_within_its_limit(spark):
    b = Bindings(spark, SF)
    pages = b.run_pages
    assert pages.count() == b.commits.count()  # one page per event
    runs = pages.groupBy("repo_full_name", "run_id", "entity_type").agg(
        F.sort_array(F.collect_list("page")).alias("pages"), F.max("max_pages").alias("limit"),
        F.min("max_pages").alias("least"),
    ).collect()
    assert all(r.pages == list(range(1, len(r.pages) + 1)) and len(r.pages) <= r.limit == r.least for r in runs)
    assert any(r.run_id.endswith(".000001") for r in runs)  # a half day that goes past the limit
    assert cov.run_stats(pages, "run_id").agg(F.sum("pages")).first()[0] == b.commits.count()


def test_last_run_counts_an_entity_that_a_run_beside_it_fetched_later(spark):
    rows = [("owner/repo", "1", "issues", 1, 100, 1, ago(3)), ("owner/repo", "2", "issues", 1, 40, 1, ago(2)),
            ("owner/repo", "1", "commits", 1, 40, 1, ago(1))]
    pages = spark.createDataFrame(
        rows, "repo_full_name string, run_id string, entity_type string, page int, items int, max_pages int, fetched_at timestamp"
    ).withColumn("limit_hit", cov.page_limit_hit("page", "items", "max_pages"))
    got = {r.entity_type: r for r in cov.coverage(make_tables(spark), pages, run="run_id").collect()}
    assert {r.last_run_id for r in got.values()} == {"owner/repo@1"}
    assert got["issues"].pages_fetched == 1 and got["issues"].last_run_truncated
