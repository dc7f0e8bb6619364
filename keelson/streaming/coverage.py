"""INC7 in streaming: the conservative history-completeness fold over a page-log stream.

State per (repository, entity) is four values: the last run day seen, the
pages and truncation of that run, and whether any run was ever truncated.
Each micro-batch is first reduced with partial aggregates to one row per
(repository, entity, run day); the previous state is added as one more row
per key, and the fold is recomputed by aggregation. The fold is associative
(sum of pages per run day, OR of truncation, arg-max by run day), so a run
day split across micro-batches still sums correctly, and no group of raw
rows ever has to sit in one task. The state is written as a versioned
snapshot per batch (see :mod:`keelson.streaming.upsert`), which makes replays
idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPO = "repo_full_name"
KEY = [REPO, "entity_type"]


def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """New state from the previous state and one batch of page-log rows."""
    per_day = batch.groupBy(*KEY, "run_day").agg(
        F.expr("count(1) AS pages"),
        F.expr("bool_or(limit_hit) AS truncated"),
        F.expr("bool_or(limit_hit) AS ever"),
        F.expr("max(fetched_at) AS refreshed_at"),
    )
    if state is not None:
        carried = state.selectExpr(
            *KEY,
            "last_run_day AS run_day",
            "last_pages AS pages",
            "last_truncated AS truncated",
            "ever_truncated AS ever",
            "refreshed_at",
        )
        per_day = per_day.unionByName(carried).groupBy(*KEY, "run_day").agg(
            F.expr("sum(pages) AS pages"),
            F.expr("bool_or(truncated) AS truncated"),
            F.expr("bool_or(ever) AS ever"),
            F.expr("max(refreshed_at) AS refreshed_at"),
        )
    return per_day.groupBy(*KEY).agg(
        F.expr("max(run_day) AS last_run_day"),
        F.expr("max_by(pages, run_day) AS last_pages"),
        F.expr("max_by(truncated, run_day) AS last_truncated"),
        F.expr("bool_or(ever) AS ever_truncated"),
        F.expr("max(refreshed_at) AS refreshed_at"),
    )
