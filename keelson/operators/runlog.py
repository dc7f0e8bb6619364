"""A transactional log of collection runs (SNK8, SNK9, INC8): epochs, fencing, six counts.

Opening a run gives it the next epoch of its repository. A run that closes while
a newer run of the repository is open or done is *fenced*: its close is kept as
such, its counts are not, so a collector that hung and came back can't pass for
the latest one. A closed run stays as it was closed.

The log is a bucketed table. A batch of opens and closes is judged against the
version that was read and committed only on top of that version; where another
writer came first, it is judged again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.kpis import REPO
from keelson.operators.ranking import running_sum
from keelson.schemas import TS, I, L, S, struct
from keelson.sources.bucketed import BucketedTable, CommitConflict

# The counts of a run, and the characters of an error that are kept.
COUNTS = (
    "issues_loaded", "pull_requests_loaded", "commits_loaded", "releases_loaded", "issue_comments_loaded", "pr_reviews_loaded",
)
ERROR_CHARS = 1000

_COUNTS = tuple((c, L) for c in COUNTS)
RUN = struct(
    (REPO, S), ("run_id", S), ("epoch", L), ("started_at", TS), ("finished_at", TS), ("status", S), ("error_message", S),
    *_COUNTS, ("closed", I),
)
#: An open has no status; a close is ``success`` or ``failed``. ``nth`` orders events of one instant.
EVENT = struct((REPO, S), ("run_id", S), ("at", TS), ("nth", L), ("status", S), ("error_message", S), *_COUNTS)


def judged(events: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of ``RUN`` that a batch of events adds to ``log``.

    Per repository events count in the order of (at, opens first, nth).
    """
    opens = F.col("status").isNull()
    ordered = events.withColumns({"_open": opens.cast("long"), "_late": (~opens).cast("int")})
    counted = running_sum(ordered, [REPO], ["at", "_late", "nth"], "_open", "_opened")
    before = log.groupBy(REPO).agg(F.max("epoch").alias("_last"))
    at_event = counted.join(before, REPO, "left").withColumn("_now", F.col("_opened") + F.coalesce("_last", F.lit(0)))
    nothing = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    begun = at_event.where(opens).select(
        REPO, "run_id", F.col("_now").alias("epoch"), F.col("at").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_message"), *nothing, F.lit(0).alias("closed"),
    )
    known = begun.unionByName(log.where("closed = 0")).select(
        REPO, "run_id", F.col("epoch"), "started_at"
    ).groupBy(REPO, "run_id").agg(F.min_by(F.struct("epoch", "started_at"), "epoch").alias("_run"))
    # the first close of a run counts
    first = at_event.where(~opens).groupBy(REPO, "run_id").agg(
        F.min_by(F.struct("at", "status", "error_message", *COUNTS, "_now"), F.struct("at", "nth")).alias("_end")
    )
    fenced = F.col("_run.epoch") < F.col("_end._now")
    success = ~fenced & (F.col("_end.status") == "success")
    ended = first.join(known, [REPO, "run_id"]).select(
        REPO, "run_id", "_run.epoch", "_run.started_at", F.col("_end.at").alias("finished_at"),
        F.when(fenced, "fenced").otherwise(F.col("_end.status")).alias("status"),
        F.substring("_end.error_message", 1, ERROR_CHARS).alias("error_message"),
        *[F.when(success, F.coalesce(F.col(f"_end.{c}"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.lit(1).alias("closed"),
    )
    return begun.unionByName(ended)


class RunLog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark = spark
        self.table = BucketedTable(spark, path).create(RUN, [REPO, "run_id"], ["closed"], buckets)

    def apply(self, events: DataFrame, batch_id: int | None = None) -> None:
        """Add a batch of events; all of it or, after a failure, nothing."""
        while True:
            version = self.table.manifest().version
            rows = judged(events, self.table.read(version=version))
            try:
                self.table.upsert(rows, batch_id, "events", expect=version)
            except CommitConflict:
                continue
            return

    def runs(self) -> DataFrame:
        return self.table.read().drop("closed")

    def _one(self, repository: str, run_id: str, status: str | None, error: str | None, counts: dict[str, int]) -> None:
        now = datetime.now(timezone.utc)
        row = (repository, run_id, now, 0, status, error, *(counts.get(c) for c in COUNTS))
        self.apply(self.spark.createDataFrame([row], EVENT))

    @contextmanager
    def run(self, repository: str, run_id: str) -> Iterator[dict[str, int]]:
        """One run: open, then closed with the counts that the body set, or with the error that it raised again."""
        self._one(repository, run_id, None, None, {})
        counts: dict[str, int] = {}
        try:
            yield counts
        except BaseException as e:
            self._one(repository, run_id, "failed", str(e) or type(e).__name__, {})
            raise
        self._one(repository, run_id, "success", None, counts)
