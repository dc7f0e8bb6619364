"""Raw feed records derived from the testdata tables (FIXTURES.md §4 notes).

These stand in for landed API pages: each builder returns the envelope
columns plus a JSON ``payload`` text column built with ``to_json`` (NULL
fields are dropped, so absent keys are truly absent), which the ingest path
then parses with the explicit raw schema exactly as it would parse files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.sources.bindings import Bindings

REPO = "repo_full_name"


def iso_micros(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_seconds(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _envelope(run_id: Column, seq: Column, payload: Column) -> list[Column]:
    """Envelope columns plus the record as JSON text (``to_json`` drops NULL
    fields, so optional keys are truly absent)."""
    return [REPO, run_id.alias("run_id"), seq.cast("long").alias("arrival_seq"), F.to_json(payload).alias("payload")]


def issue_feed(b: Bindings) -> DataFrame:
    """The issues endpoint: issues and PRs (PRs carry ``pull_request``)."""
    i = b._items
    n = F.col("number")
    closed = F.col("state") == "closed"
    labels = F.array(
        F.struct(F.col("title").alias("name")),
        F.struct(F.lit("").alias("name")),
        F.struct(F.when(closed, F.lit("done")).alias("name")),
    )
    payload = F.struct(
        n.alias("number"),
        F.col("state").alias("state"),
        F.when(n % 50 != 0, F.struct(F.col("author").alias("login"))).alias("user"),
        F.col("title").alias("title"),
        labels.alias("labels"),
        F.when(n % 3 != 0, (n % 7).cast("int")).alias("comments"),
        (n % 11 == 0).alias("locked"),
        iso_seconds("created_at").alias("created_at"),
        iso_seconds(F.coalesce("closed_at", "created_at")).alias("updated_at"),
        iso_seconds("closed_at").alias("closed_at"),
        F.when(F.col("o_orderpriority") < "3", F.struct(F.lit("x").alias("url"))).alias(
            "pull_request"
        ),
    )
    return i.select(*_envelope(F.lit("r1"), n, payload))


def pull_feed(b: Bindings) -> DataFrame:
    """The pulls endpoint; every 97th PR has no ``updated_at``."""
    p = b.pull_requests
    n = F.col("pr_number")
    payload = F.struct(
        n.alias("number"),
        F.col("state"),
        F.struct(F.col("author").alias("login")).alias("user"),
        F.col("title"),
        F.col("draft"),
        iso_seconds("created_at").alias("created_at"),
        F.when(n % 97 != 0, iso_seconds("updated_at")).alias("updated_at"),
        iso_seconds("closed_at").alias("closed_at"),
        iso_seconds("merged_at").alias("merged_at"),
    )
    return p.select(*_envelope(F.lit("r2"), n, payload))


def commit_feed(b: Bindings, ev: DataFrame | None = None) -> DataFrame:
    """Commits from events: ``sha`` repeats per (user, event type) so later
    arrivals replace earlier ones; error events with value < 5 carry no date.
    ``ev`` may be a streaming DataFrame of events with their repository."""
    e = b._ev if ev is None else ev
    uid = F.col("user_id").cast("string")
    is_error = F.col("event_type") == "error"
    author_date = F.when(~(is_error & (F.col("value") < 5)), iso_micros("ts"))
    committer_date = F.when(~is_error, iso_micros(F.col("ts") + F.expr("INTERVAL 60 SECONDS")))
    payload = F.struct(
        F.concat(uid, F.lit("-"), F.col("event_type")).alias("sha"),
        F.when(F.col("user_id") % 3 != 0, F.struct(F.concat(F.lit("u"), uid).alias("login"))).alias(
            "author"
        ),
        F.struct(
            F.col("props").alias("message"),
            F.struct(F.concat(F.lit("name"), uid).alias("name"), author_date.alias("date")).alias(
                "author"
            ),
            F.struct(F.concat(F.lit("name"), uid).alias("name"), committer_date.alias("date")).alias(
                "committer"
            ),
        ).alias("commit"),
    )
    return e.select(
        *_envelope(F.date_format("ts", "yyyyMMdd"), F.col("event_id"), payload),
        F.to_date("ts").alias("day"),
    )


def repository_feed(b: Bindings) -> DataFrame:
    """Repository metadata records; some lack ``subscribers_count`` or a license id."""
    d = b.repo_dim
    k = F.col("n_nationkey")
    payload = F.struct(
        F.col(REPO).alias("full_name"),
        F.when(k % 4 == 0, F.concat(F.lit("about "), F.col(REPO))).alias("description"),
        (k * 100).cast("long").alias("stargazers_count"),
        F.when(k % 5 != 0, (k * 10).cast("long")).alias("forks_count"),
        F.when(k % 2 == 0, (k * 3).cast("long")).alias("subscribers_count"),
        (k * 7).cast("long").alias("watchers_count"),
        F.lit("main").alias("default_branch"),
        F.col("r_name").alias("language"),
        F.when(
            k % 3 != 0,
            F.struct(
                F.when(k % 3 == 1, F.lit("MIT")).alias("spdx_id"),
                F.concat(F.lit("License "), k.cast("string")).alias("name"),
            ),
        ).alias("license"),
        F.lit("2000-01-01T00:00:00Z").alias("created_at"),
    )
    return d.select(*_envelope(F.lit("r0"), k, payload))


def release_feed(b: Bindings) -> DataFrame:
    r = b.releases
    rid = F.col("release_id")
    payload = F.struct(
        rid.alias("id"),
        F.concat(F.lit("v"), rid.cast("string")).alias("tag_name"),
        F.col("draft"),
        F.when(rid % 7 == 0, F.lit(True)).alias("prerelease"),
        iso_micros("created_at").alias("created_at"),
        iso_micros("published_at").alias("published_at"),
    )
    return r.select(*_envelope(F.lit("r3"), rid, payload))


#: The ISO-8601 forms that collectors deliver; a record's number picks one.
_TIME_FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'Z'", "yyyyMMdd'T'HHmmss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'+0000'", "yyyy-MM-dd'T'HH:mm:ss'+00'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
)


def _some_form(c: str, pick: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, form in enumerate(_TIME_FORMS):
        out = F.when(pick % len(_TIME_FORMS) == i, F.date_format(c, form)).otherwise(out)
    return out


def comment_feed(b: Bindings) -> DataFrame:
    """The comments endpoint with every arrival of an id; some URLs lack a number, some users are gone."""
    e = b.events_for(b.issues, "issue_number", b.item_event_versions)
    n = F.col("number")
    payload = F.struct(
        F.col("event_id").alias("id"),
        F.concat(F.lit("https://api.example.org/repos/"), REPO, F.lit("/issues/"), F.when(n % 41 != 0, n.cast("string")).otherwise("")).alias("issue_url"),
        F.when(n % 50 != 0, F.struct(F.col("author").alias("login"))).alias("user"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("body"),
        _some_form("created_at", n).alias("created_at"),
    )
    return e.select(*_envelope(F.lit("r4"), F.col("arrival_seq"), payload))


def review_feed(b: Bindings) -> DataFrame:
    """The reviews endpoint with every arrival of an id; pending reviews have no time."""
    e = b.events_for(b.pull_requests, "pr_number", b.item_event_versions)
    n = F.col("number")
    payload = F.struct(
        F.col("event_id").alias("id"),
        n.alias("pr_number"),
        F.struct(F.col("author").alias("login")).alias("user"),
        F.when(F.col("l_linenumber") % 3 == 0, "APPROVED").otherwise("COMMENTED").alias("state"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).alias("body"),
        F.when(n % 43 != 0, _some_form("created_at", n)).alias("submitted_at"),
    )
    return e.select(*_envelope(F.lit("r5"), F.col("arrival_seq"), payload))
