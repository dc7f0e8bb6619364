"""Stored entity tables: the bound entities materialised once as Parquet.

In a deployment the ingest job writes the normalised entity tables and every
metric reads them. Here the first query over a testdata folder writes them
into the shared folder named by ``spark.checkpoint.dir`` (never a
machine-local path on a cluster); later queries reuse them. Each table is
written as its rows come out of the scans and joins, without a shuffle of its own,
and sorted by time within files so Parquet row-group statistics let time-window
filters skip data.
A table counts as present only when its ``_SUCCESS`` marker exists; tables
are published by an atomic rename, and the folder name carries a fingerprint
of the inputs and of the deriving code.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.tables import Tables
from keelson.schemas import KEYS
from keelson.session import scratch_path
from keelson.sources.bucketed import BucketedTable

# Stored entities, their natural keys and their time column.
LAYOUT = {
    "repositories": (("repo_full_name",), None),
    "issues": (("repo_full_name", "issue_number"), "created_at"),
    "pull_requests": (("repo_full_name", "pr_number"), "created_at"),
    "commits": (("repo_full_name", "sha"), "committed_at"),
    "releases": (("repo_full_name", "release_id"), "created_at"),
    "issue_comments": (("repo_full_name", "issue_number", "comment_id"), "created_at"),
    "pr_reviews": (("repo_full_name", "pr_number", "review_id"), "submitted_at"),
    "pipeline_runs": (("run_id",), "started_at"),
    "page_log": (("repo_full_name", "page_seq"), "fetched_at"),
}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _fs_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def publish(spark: SparkSession, write, path: str) -> None:
    """Write to a private temporary folder, then rename it into place.

    The rename is atomic on HDFS-like and local file systems, so readers see
    either no table or a complete one; if a concurrent run published first,
    its (identical) table is kept and ours is discarded.
    """
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    write(tmp)
    src, fs = _fs(spark, tmp)
    dst, _ = _fs(spark, path)
    if not fs.exists(dst) and fs.rename(src, dst):
        return
    fs.delete(src, True)


WRITERS = 4  # concurrent table-writing jobs
SHARED_JOIN = ("issue_comments", "pr_reviews")  # entities of one join, written one after the other
#: Bytes of a scan's or shuffle's part while tables are written: what a task hashes or sorts then fits its memory.
PART_BYTES = 8 << 20
PART_SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
TABLE_BUCKETS = 16  # hash buckets of a merged entity table; a deployment sets them by its rows


def write_table(df: DataFrame, path: str, time_col: str | None) -> None:
    out = df.sortWithinPartitions(time_col) if time_col else df
    publish(df.sparkSession, lambda target: out.write.parquet(target), path)


def _bytes(size: str) -> int:
    """A size as Spark's settings write it, in bytes."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


@contextmanager
def small_parts(spark: SparkSession):
    """Parts of at most ``PART_BYTES`` inside; settings that ask for smaller ones stay, and all are put back."""
    before = {name: spark.conf.get(name) for name in PART_SETTINGS}
    try:
        for name, size in before.items():
            spark.conf.set(name, str(min(_bytes(size), PART_BYTES)))
        yield
    finally:
        for name, size in before.items():
            spark.conf.set(name, size)


def store(spark: SparkSession, source, root: str) -> Tables:
    """Write every entity of ``source`` (missing ones only) and return the stored tables."""
    missing = [
        name for name in LAYOUT if not _fs_exists(spark, os.path.join(root, name, "_SUCCESS"))
    ]
    if missing:
        shared = source.shared_inputs() if hasattr(source, "shared_inputs") else nullcontext()

        def write(names: list[str]) -> None:
            for name in names:
                write_table(getattr(source, name), os.path.join(root, name), LAYOUT[name][1])

        # Independent tables are written as concurrent Spark jobs; of those that share a join
        # the second finds it cached.
        joined = [n for n in missing if n in SHARED_JOIN]
        with small_parts(spark), shared, ThreadPoolExecutor(max_workers=WRITERS) as pool:
            list(pool.map(write, [joined, *([n] for n in missing if n not in SHARED_JOIN)]))
    return Tables(**{name: spark.read.parquet(os.path.join(root, name)) for name in LAYOUT})


_OPENED: dict[tuple[str, str], Tables] = {}


_SOURCES = ("bindings", "testfeeds", "warehouse", "landing", "feeds", "bucketed")


def fingerprint(bindings) -> str:
    """Tag of derived folders: every input file (path, size, time; listed by
    Hadoop, so any store) and the code that derives from them, so a change to
    either never reuses stale tables."""
    path, fs = _fs(bindings.spark, bindings.sf_dir)
    h = hashlib.sha1(str(fs.makeQualified(path)).encode())
    found = []
    files = fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    h.update("\n".join(sorted(found)).encode())
    for src in _SOURCES:
        h.update(inspect.getsource(importlib.import_module(f"{__package__}.{src}")).encode())
    return h.hexdigest()[:16]


def stored_tables(bindings) -> Tables:
    """Stored entities for a testdata folder, materialised on first use.

    Opened tables are remembered per (application, folder) so repeated queries
    in one session skip re-listing the files; a missing marker reopens them."""
    spark = bindings.spark
    root = scratch_path(spark, f"warehouse-{fingerprint(bindings)}")
    key = (spark.sparkContext.applicationId, root)
    cached = _OPENED.get(key)
    if cached is not None and _fs_exists(spark, os.path.join(root, "page_log", "_SUCCESS")):
        return cached
    _OPENED[key] = store(spark, bindings, root)
    return _OPENED[key]


def table_path(bindings, name: str) -> str:
    """Folder of one stored entity table (materialising the tables if needed)."""
    stored_tables(bindings)
    return os.path.join(scratch_path(bindings.spark, f"warehouse-{fingerprint(bindings)}"), name)


def keyed_table(bindings, name: str, entity: str, batches: list[DataFrame], order: str = "arrival_seq") -> BucketedTable:
    """A bucketed table of ``entity`` that ``batches`` were merged into, one after the other.

    Batches are numbered, so a table that has them already is left as it is.
    """
    path = scratch_path(bindings.spark, f"merged-{fingerprint(bindings)}/{name}")
    table = BucketedTable(bindings.spark, path).create(batches[0].schema, KEYS[entity], [order], TABLE_BUCKETS)
    for number, batch in enumerate(batches):
        table.upsert(batch, number)
    return table
