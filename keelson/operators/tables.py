"""The entity tables a metric reads, as one bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Tables:
    """Normalised entity tables (see SURVEY §1.2). Any object with these
    attributes works, e.g. :class:`keelson.sources.bindings.Bindings`."""

    repositories: DataFrame
    issues: DataFrame
    pull_requests: DataFrame
    commits: DataFrame
    releases: DataFrame
    issue_comments: DataFrame
    pr_reviews: DataFrame
    pipeline_runs: DataFrame | None = None
    page_log: DataFrame | None = None
