"""M13, M14, INC9 live: first responses from a stream of items and a stream of events.

Both streams carry watermarks and are joined on the item within a range of event
time, so state is bounded by the range. An item without a response comes out
once the watermark has passed all of its range. Every match comes out as it is
found; the sink is a bucketed table of one row per item that keeps the earliest,
so replayed batches change nothing. Events later than the watermark are dropped
by the join; how many is told apart. Executors hold the state of a batch in
memory, so periods of many rows are landed in pieces, cut at the same instants
for both streams: a batch is a piece of each.
"""

from __future__ import annotations

import os
import time as clock
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryProgress

from keelson.functions.predicates import not_bot
from keelson.operators.kpis import REPO
from keelson.schemas import TS, L, S, struct
from keelson.sources.bucketed import BucketedTable
from keelson.sources.warehouse import _fs, _fs_exists

#: Days after (and before, for clocks that disagree) an item's creation in which a response counts.
AFTER_DAYS, BEFORE_DAYS = 125, 1
DELAY = "1 day"
#: Rows of both streams in a batch, about; bytes of a row group of a landed file, by which one file is read in parallel.
PIECE_ROWS, GROUP_BYTES = 2_000_000, 4 << 20
#: Batches whose rows are added to the table of responses before it is compacted.
DELTAS = 32

ROW = struct((REPO, S), ("number", L), ("created_at", TS), ("first_response_at", TS), ("earlier", L))


@dataclass
class Live:
    """The table of first responses, the events that came too late, and the most rows that the join held after a batch."""

    table: BucketedTable
    late: int
    held: int = 0

    def responses(self) -> DataFrame:
        return self.table.read().drop("earlier")


def joined(items: DataFrame, events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Items (repository, number, author, created_at) with each event (repository, number, author, at) that answers them."""
    i = items.withWatermark("created_at", delay).alias("i")
    e = events.where(not_bot("author")).withWatermark("at", delay).alias("e")
    answers = F.expr(
        f"i.{REPO} = e.{REPO} and i.number = e.number and i.author <> e.author "
        f"and e.at >= i.created_at - interval {BEFORE_DAYS} days and e.at <= i.created_at + interval {AFTER_DAYS} days"
    )
    rows = i.join(e, answers, "left_outer")
    return rows.select(
        f"i.{REPO}", F.col("i.number").cast("long").alias("number"), "i.created_at", F.col("e.at").alias("first_response_at"),
        F.coalesce(-F.unix_micros("e.at"), F.lit(-(2**63) + 1)).alias("earlier"),
    )


def run(items: DataFrame, events: DataFrame, base: str, delay: str = DELAY, buckets: int = 16) -> Live:
    """Take in all that both streams have, batch by batch, below the folder ``base``."""
    spark = items.sparkSession
    table = BucketedTable(spark, os.path.join(base, "table"), max_deltas=DELTAS).create(ROW, [REPO, "number"], ["earlier"], buckets)
    seen: dict[int, tuple[int, int]] = {}  # by batch: a query remembers its last hundred only
    started: list[StreamingQuery] = []

    def note(progress: Iterable[StreamingQueryProgress | None]) -> None:
        for p in filter(None, progress):
            late, held = (sum(getattr(op, x) for op in p.stateOperators) for x in ("numRowsDroppedByWatermark", "numRowsTotal"))
            before = seen.get(p.batchId, (0, 0))
            seen[p.batchId] = max(before[0], late), max(before[1], held)

    def take(batch: DataFrame, batch_id: int) -> None:
        note(q.lastProgress for q in started)  # of the batch before
        table.upsert(batch, batch_id, "responses")

    query = (
        joined(items, events, delay).writeStream
        .foreachBatch(take)
        .option("checkpointLocation", os.path.join(base, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    started.append(query)
    query.awaitTermination()
    note(query.recentProgress)
    return Live(table, sum(late for late, _ in seen.values()), max((held for _, held in seen.values()), default=0))


def instants(streams: list[tuple[DataFrame, str]], ends: list, most: int = PIECE_ROWS) -> list:
    """``ends`` and the instants between them by which all streams together are cut into pieces of about ``most`` rows.

    Streams cut at the same instants advance together, so the join holds a piece of each and the rows within its range.
    """
    times = reduce(DataFrame.unionAll, [rows.select(F.col(time).alias("at")).where(F.col(time) < F.lit(ends[-1])) for rows, time in streams])
    pieces = -(-times.count() // most)
    if pieces < 2:
        return ends
    between = times.agg(F.percentile_approx("at", [i / pieces for i in range(1, pieces)])).first()[0]
    return sorted({*ends, *between})


def land_in_time_order(rows: DataFrame, time: str, ends: list, folder: str) -> None:
    """``rows`` as one file for each period up to an end, the earliest landed first, as a feed would land them.

    All are written at once, beside ``folder``, and moved into it in their order; a
    stream takes files by the time of their last change, which is that of the move.
    """
    spark, written = rows.sparkSession, f"{folder}-{uuid.uuid4().hex}"
    period = F.when(F.col(time) < F.lit(ends[0]), 0)
    for number, until in enumerate(ends[1:], 1):
        period = period.when(F.col(time) < F.lit(until), number)
    dealt = rows.where(F.col(time) < F.lit(ends[-1])).withColumn("_period", period).repartitionById(len(ends), "_period")
    dealt.write.partitionBy("_period").option("parquet.block.size", GROUP_BYTES).parquet(written)
    target, fs = _fs(spark, folder)
    fs.mkdirs(target)
    landed = 0
    for number in range(len(ends)):
        place = os.path.join(written, f"_period={number}")
        if not _fs_exists(spark, place):  # a period without rows is an empty file: streams stay abreast
            spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(place)
        for file in fs.listStatus(_fs(spark, place)[0]):
            name = file.getPath().getName()
            if name.endswith(".parquet"):
                landed = max(landed + 1, int(clock.time() * 1000))
                to, _ = _fs(spark, os.path.join(folder, f"{number:06d}-{name}"))
                fs.setTimes(file.getPath(), landed, -1)
                if not fs.rename(file.getPath(), to):
                    raise OSError(f"{to} was not landed")
    fs.delete(_fs(spark, written)[0], True)
