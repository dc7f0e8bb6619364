"""The paged feed: early stop at a cursor, overlap, repositories without one, a stream whose offsets are cursors."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.session import scratch_path
from keelson.sources import paged
from keelson.sources.paged import PagedFeed, read_since, write_pages

T0 = datetime(2024, 1, 1)
ROWS = "repo_full_name string, n long, at timestamp"


def schema():
    return StructType.fromDDL(ROWS)


def records(spark, repo, n, step=timedelta(hours=1)):
    return spark.createDataFrame([(repo, i, T0 + i * step) for i in range(n)], ROWS)


@pytest.fixture
def path(spark):
    return scratch_path(spark, f"t-pages-{uuid.uuid4().hex}")


def test_a_feed_without_cursor_is_read_whole(spark, path):
    rows = records(spark, "o/r", 950).union(records(spark, "o/s & t", 3))
    write_pages(rows, "at", ["n"], path)
    got = read_since(spark, path, schema(), "at")
    assert got.drop("page").exceptAll(rows).count() == 0 and got.count() == 953
    newest = {r.repo_full_name: r.n for r in got.where("page = 0").groupBy("repo_full_name").agg(F.min("n").alias("n")).collect()}
    assert newest == {"o/r": 850, "o/s & t": 0} and got.rdd.getNumPartitions() == 2


def test_pages_behind_the_cursor_are_not_read(spark, path, monkeypatch):
    write_pages(records(spark, "o/r", 950).union(records(spark, "o/new", 250)), "at", ["n"], path)
    since = spark.createDataFrame([("o/r", T0 + timedelta(hours=820))], "repo_full_name string, since timestamp")
    got = read_since(spark, path, schema(), "at", since).collect()
    mine = sorted((r.n, r.page) for r in got if r.repo_full_name == "o/r")
    assert [n for n, _ in mine] == list(range(820, 950)) and {p for _, p in mine} == {0, 1}
    assert sum(r.repo_full_name == "o/new" for r in got) == 250  # no cursor: all of it
    opened = []
    page = paged._Pages.page
    monkeypatch.setattr(paged._Pages, "page", lambda self, r, k: opened.append(k) or page(self, r, k))
    reader = PagedFeed({"path": path, "time": "at"}).reader(paged.with_page(schema()))
    list(reader.read(paged._Share("o/r", (T0 + timedelta(hours=820)).isoformat())))
    some = len(opened)
    list(reader.read(paged._Share("o/r", None)))
    assert some == 2 and len(opened) - some == 11  # ten pages and the end


def test_records_within_the_overlap_come_again(spark, path):
    write_pages(records(spark, "o/r", 300, timedelta(minutes=1)), "at", ["n"], path)
    since = spark.createDataFrame([("o/r", T0 + timedelta(minutes=200))], "repo_full_name string, since timestamp")
    assert read_since(spark, path, schema(), "at", since).agg(F.min("n")).first()[0] == 195


def test_a_stream_goes_on_from_its_cursors(spark, path):
    spark.dataSource.register(PagedFeed)
    out, checkpoint = (scratch_path(spark, f"t-{k}-{uuid.uuid4().hex}") for k in ("out", "ck"))

    def run():
        stream = spark.readStream.format("paged_feed").schema(paged.with_page(schema())).option("path", path).option("time", "at").load()
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()

    write_pages(records(spark, "o/r", 250), "at", ["n"], path)
    run()
    assert spark.read.parquet(out).count() == 250
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    write_pages(records(spark, "o/r", 400).union(records(spark, "o/late", 5)), "at", ["n"], path)  # the feed went on
    run()
    got = spark.read.parquet(out)
    again = got.groupBy("repo_full_name", "n").count().where("count > 1")
    assert got.select("repo_full_name", "n").distinct().count() == 405
    assert [r.n for r in again.collect()] == [249]  # the overlap: the cursor's own record
