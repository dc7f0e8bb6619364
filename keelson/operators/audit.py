"""INC8 / SNK8-9: run audit around a collection job, with failure capture.

Each run appends a ``running`` event to an append-only run log (Parquet in
the shared folder) when it starts and a terminal event when it ends:
``success`` with the loaded counts, or ``failed`` with the first 1000
characters of the error -- after which the error is re-raised. The current
state of every run is :func:`keelson.operators.incremental.current_runs`
over the log, so no row is ever updated in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from keelson.operators.incremental import ENTITIES, current_runs

# Error text kept in the run log.
ERROR_TEXT_LIMIT = 1000

EVENT_SCHEMA = (
    "run_id string, repo_full_name string, started_at timestamp, finished_at timestamp, "
    "status string, issues_loaded int, pull_requests_loaded int, commits_loaded int, "
    "releases_loaded int, issue_comments_loaded int, pr_reviews_loaded int, max_pages int, "
    "is_incremental boolean, error_message string, event_seq int"
)


def _utcnow() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _append(spark: SparkSession, log_path: str, row: tuple) -> None:
    spark.createDataFrame([row], EVENT_SCHEMA).write.mode("append").parquet(log_path)


@contextmanager
def audited_run(
    spark: SparkSession,
    log_path: str,
    run_id: str,
    repository: str,
    *,
    max_pages: int = 10,
    is_incremental: bool = False,
    clock=_utcnow,
) -> Iterator[dict[str, int]]:
    """Yield a counts dict for the job to fill (entity -> rows loaded)."""
    started = clock()
    _append(
        spark, log_path,
        (run_id, repository, started, None, "running", *[0] * len(ENTITIES), max_pages,
         is_incremental, None, 0),
    )
    counts: dict[str, int] = {}
    try:
        yield counts
    except Exception as exc:
        _append(
            spark, log_path,
            (run_id, repository, started, clock(), "failed",
             *[int(counts.get(e, 0)) for e in ENTITIES], max_pages, is_incremental,
             str(exc)[:ERROR_TEXT_LIMIT], 1),
        )
        raise
    _append(
        spark, log_path,
        (run_id, repository, started, clock(), "success",
         *[int(counts.get(e, 0)) for e in ENTITIES], max_pages, is_incremental, None, 1),
    )


def run_state(spark: SparkSession, log_path: str) -> DataFrame:
    """Current state of every audited run."""
    return current_runs(spark.read.schema(EVENT_SCHEMA).parquet(log_path))
