"""Landing zone: raw feed records as JSON-lines files, read back with a schema.

The testdata-derived feeds (:mod:`keelson.sources.testfeeds`) are written once
per testdata folder under the shared ``spark.checkpoint.dir`` -- one folder per
entity, commits partitioned by landing ``day`` -- exactly as an API collector
would land pages. Queries then read them with :func:`keelson.sources.feeds.read_feed`
(explicit schema, never inferred), so the read is split across files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.schemas import ENVELOPE, RAW
from keelson.session import scratch_path
from keelson.sources import testfeeds
from keelson.sources.warehouse import _fs_exists, fingerprint, publish

# Landed feeds, their builders and folder partitioning.
FEEDS = {
    "issues": (testfeeds.issue_feed, None),
    "pull_requests": (testfeeds.pull_feed, None),
    "commits": (testfeeds.commit_feed, "day"),
    "repository": (testfeeds.repository_feed, None),
    "releases": (testfeeds.release_feed, None),
    "issue_comments": (testfeeds.comment_feed, None),
    "pr_reviews": (testfeeds.review_feed, None),
}

ENV = [f.name for f in ENVELOPE.fields]


def records(feed: DataFrame, entity: str) -> DataFrame:
    """Envelope + record fields from a feed carrying JSON text in ``payload``."""
    extra = [c for c in feed.columns if c not in (*ENV, "payload")]
    parsed = F.from_json("payload", RAW[entity]).alias("r")
    return feed.select(*ENV, *extra, parsed).select(*ENV, *extra, "r.*")


def landing_root(b) -> str:
    return scratch_path(b.spark, f"landing-{fingerprint(b)}")


def land(b, entity: str) -> str:
    """Path of the landed feed of ``entity`` (written on first use)."""
    path = os.path.join(landing_root(b), entity)
    if not _fs_exists(b.spark, os.path.join(path, "_SUCCESS")):
        builder, part = FEEDS[entity]
        out = records(builder(b), entity)
        # One cluster of files per day; Spark splits a large day and merges small ones by bytes.
        out = out.hint("rebalance", F.col(part)) if part else out.hint("rebalance")
        writer = out.write.partitionBy(part) if part else out.write
        publish(b.spark, writer.json, path)
    return path


def land_all(b) -> None:
    """Land every feed (missing ones only) as concurrent Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=len(FEEDS)) as pool:
        list(pool.map(lambda name: land(b, name), FEEDS))
