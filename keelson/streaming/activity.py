"""INC9: live activity counts with Structured Streaming.

Events are read as a file stream, given their repository by a stream-static
join, and counted per (repository, 1-day event-time window, activity type).
A watermark bounds the state: a window is emitted once (append mode) when
the watermark passes its end, and its state is then dropped, so state size
is bounded by the windows still open, not by history.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.sources.bindings import Bindings

REPO = "repo_full_name"


def event_stream(spark: SparkSession, source_dir: str, schema: StructType, glob: str | None = None,
                 max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source_dir)


def activity_counts(
    events: DataFrame, delay: str = "5 minutes", size: str = "1 day", key: str | None = "event_id"
) -> DataFrame:
    """Windowed counts; ``events`` needs repo_full_name, ts (timestamp), event_type.

    Events re-landed by the collector's cursor overlap are dropped by ``key``
    with ``dropDuplicatesWithinWatermark`` (first arrival wins; events are
    immutable), whose state is also bounded by the watermark.
    """
    watermarked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    if key:
        watermarked = watermarked.dropDuplicatesWithinWatermark([key])
    return (
        watermarked
        .groupBy(REPO, F.window("ts", size).alias("w"), F.col("event_type").alias("activity_type"))
        .agg(F.count(F.lit(1)).alias("activity_count"))
        .select(
            REPO,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "activity_type",
            "activity_count",
        )
    )


def run_activity_stream(
    b: Bindings, out_dir: str, delay: str = "5 minutes", source_dir: str | None = None
) -> DataFrame:
    """Run the stream over everything available now, then return the sink."""
    spark = b.spark
    schema = b.table("events").schema
    if source_dir is None:
        stream = event_stream(spark, b.sf_dir, schema, glob="events.parquet")
    else:
        stream = event_stream(spark, source_dir, schema)
    counts = activity_counts(b.events_with_repo(stream), delay)
    sink = os.path.join(out_dir, "sink")
    query = (
        counts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", os.path.join(out_dir, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(sink)


def activity_counts_batch(events: DataFrame, size: str = "1 day") -> DataFrame:
    """The batch twin of :func:`activity_counts` (all windows, closed or not)."""
    return (
        events.groupBy(REPO, F.window(F.col("ts").cast("timestamp"), size).alias("w"),
                       F.col("event_type").alias("activity_type"))
        .agg(F.count(F.lit(1)).alias("activity_count"))
        .select(REPO, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "activity_type", "activity_count")
    )
