"""Shared pieces: byte-level text blocks for numpy, content hashes, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.session import checkpoint_dir

#: Bytes of text that a task handles in numpy at once; bounds a worker's memory.
BLOCK_BYTES = 1 << 22
#: Rows up to which a small table may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000
#: Seconds after which the JVM knows the frames that Python let go.
LET_GO_S = 1.3
#: Seconds in which Spark's cleaner deletes what a collection found.
CLEAN_S = 0.7

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, as ``--py-files`` would.

    Nothing to do where the package's folder is in PYTHONPATH. The archive is
    made on the driver and served by Spark.
    """
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    archive = os.path.join(tempfile.mkdtemp(prefix="keelson-py-"), "keelson.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "keelson").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(archive)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints of frames that nobody holds any more.

    Spark does so when the driver's JVM collects them, which a small driver's
    heap may put off until the disks are full. The JVM holds a frame until
    py4j's worker has told it that Python let go, which it does every second.
    What a first collection only makes reachable to Spark's cleaner goes with
    the second; files go a moment after each.
    """
    gc.collect()
    time.sleep(LET_GO_S)
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(CLEAN_S)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` stay within ``limit``; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def whole_texts(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a batch's text column; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"")


def schema_of(df: DataFrame, *extra: str) -> str:
    """DDL of all columns of ``df``, then ``extra``."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *extra])


def set_aside(columns: list[str]) -> tuple[list[Column], list[Column]]:
    """A caller's columns under names of this package's own, so that none clashes, and back under theirs."""
    away = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)]
    return away, [F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)]


def without(columns: list[str], names: list[str]) -> list[str]:
    """``columns`` but those that output columns replace (names differ in more than capitals, as Spark tells them apart)."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def random_table(seed: int) -> np.ndarray:
    """256 fixed 64-bit values, one per byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = self._table(_BASE, 1024), self._table(_INVERSE, 1024)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = self._table(_BASE, size), self._table(_INVERSE, size)


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` reads the hash of any span."""
    POWERS.need(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * POWERS.down[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end); equal for equal spans wherever they stand."""
    return mix((prefix[end] - prefix[start]) * POWERS.up[start])


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of values of at most ``limit`` bytes together (a larger value stands alone), with the first's index."""
    values = column.to_pylist()
    first = size = 0
    for i, v in enumerate(values):
        if i > first and size + len(v) > limit:
            yield first, values[first:i]
            first, size = i, 0
        size += len(v)
    if first < len(values):
        yield first, values[first:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, and where each starts and ends in it."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(texts), np.uint8), ends - lengths, ends


def words_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Start and end of every word (a run without ASCII white space) and the index of its text.

    Texts are adjacent in ``buf``: a word never crosses the end of its text.
    """
    word = ~WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[starts] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:-1]
    w0, w1 = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return w0, w1, np.searchsorted(ends, w0, side="right")


#: The ASCII white space that ends a word.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def numbered(rows: DataFrame, group: list[str], order: list[str], weight: str, buckets: DataFrame | int) -> DataFrame:
    """``rows`` with ``rank``: where a row's ``weight`` numbers begin, dense from 0 within each ``group``.

    ``buckets`` has for each group the number of buckets ``n_buckets`` to count
    in, at most 100,000 rows in all (it is broadcast), or is their number where
    there is one group; about the square root of
    a group's rows keeps both the buckets and the table of their sums small.
    Rows are dealt by a hash of ``order``, so a large group is spread, and the
    numbers depend on the rows alone. Rows equal in ``order`` should be summed
    into one row first.
    """
    if isinstance(buckets, int):
        counted = rows.withColumn("n_buckets", F.lit(buckets).cast("long"))
    else:
        counted = rows.join(F.broadcast(buckets), group)
    dealt = counted.withColumn(
        "__bucket", F.pmod(F.xxhash64(*order), F.col("n_buckets"))
    )
    sums = dealt.groupBy(*group, "__bucket").agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("__own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(sums, [*group, "__bucket"])
        .withColumn("rank", F.col("__offset") + F.col("__own"))
        .drop("__bucket", "__own", "__offset", "n_buckets")
    )


def bucket_counts(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """The ``buckets`` of :func:`numbered` from the row count of each group."""
    return counts.select(*group, F.ceil(F.sqrt(n)).alias("n_buckets"))
