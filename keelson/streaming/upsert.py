"""INC3: idempotent incremental upserts with ``foreachBatch``.

Keyed rows go to a bucketed table (:mod:`keelson.sources.bucketed`): a
micro-batch writes delta files for the buckets that it touches and commits them
with its number, so a batch replayed after a failure is not applied twice and
nothing stored is rewritten but buckets that are due for compaction.

State that is folded (coverage by run day) is small and is written whole as
version ``batch_id + 1``, committed by its ``_SUCCESS`` marker; versions older
than the one that was read go.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.sources.bucketed import BucketedTable


def _versions(spark: SparkSession, snapshot_dir: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(snapshot_dir)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def latest_snapshot(spark: SparkSession, snapshot_dir: str) -> DataFrame | None:
    versions = _versions(spark, snapshot_dir)
    if not versions:
        return None
    return spark.read.parquet(os.path.join(snapshot_dir, f"v={versions[-1]}"))


def upsert_batches(
    snapshot_dir: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function merging each batch into the versioned snapshot."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = os.path.join(snapshot_dir, f"v={batch_id + 1}")
        previous = [v for v in _versions(spark, snapshot_dir) if v <= batch_id]
        current = (
            spark.read.parquet(os.path.join(snapshot_dir, f"v={previous[-1]}")) if previous else None
        )
        merge(current, batch).write.mode("overwrite").parquet(target)
        for old in previous[:-1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(snapshot_dir, f"v={old}"))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return apply


def run_upsert_stream(
    stream: DataFrame,
    snapshot_dir: str,
    checkpoint_dir: str,
    merge: Callable[[DataFrame | None, DataFrame], DataFrame],
) -> DataFrame:
    query = (
        stream.writeStream.foreachBatch(upsert_batches(snapshot_dir, merge))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return latest_snapshot(stream.sparkSession, snapshot_dir)


def run_table_stream(stream: DataFrame, table: BucketedTable, checkpoint_dir: str, name: str) -> DataFrame:
    """Apply every available micro-batch of ``stream`` to ``table``; then its rows."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id, name) and None)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    table.vacuum()
    return table.read()
