"""Sharding by a Feistel permutation over global row numbers.

Rows get dense numbers that depend on the rows alone; a keyed Feistel network
with cycle walking permutes 0..n-1; shard and slot are the remainder and the
quotient of the permuted number by the number of shards. So shard sizes differ
by one row at most (the law ``rows``), the order is a reproducible shuffle, and
:func:`row_number_at` computes which row a shard's slot holds without a lookup.

Defined cases: null texts have no bytes; rows equal in id and text are
interchangeable and get neighbouring numbers; null ids are numbered like
others; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut, mix, numbered

SHARDS = 40
ROUNDS = 6
#: Bytes counted for a row besides its text.
ROW_BYTES = 16
#: Equal rows unfolded at once; more are dealt to other tasks first.
UNFOLD = 10_000


def _half_bits(n: int) -> int:
    """Bits of each half: the smallest balanced network over at least n numbers."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in keys:
        left, right = right, left ^ (mix(right + k) & mask)
    return (right << shift) | left


def _walk(x: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Apply the network until the number is below n; a walk ends as it stays on one cycle."""
    out = _network(x.astype(np.uint64), _half_bits(n), keys)
    far = np.flatnonzero(out >= n)
    while len(far):
        out[far] = _network(out[far], _half_bits(n), keys)
        far = far[out[far] >= n]
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permutation of 0..n-1 at ``x``."""
    return _walk(x, n, _keys(seed))


def invert(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The numbers that :func:`permute` sends to ``y``: the network run with its keys reversed."""
    return _walk(y, n, _keys(seed)[::-1])


def row_number_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The global row number at a shard's slot."""
    return invert(slot * shards + shard, n, seed)


def assign(
    docs: DataFrame, shards: int = SHARDS, seed: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row of ``docs``.

    Rows equal in id and text are summed into one before they are numbered and
    unfolded after, so a hot id or text stays one row in the shuffles. Unfolding
    deals stretches of at most :data:`UNFOLD` numbers to the tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
    )
    same = ["doc_id", "size", "text_crc32", "digest"]
    rows = cut(thin.groupBy(*same).agg(F.count("*").alias("copies")).withColumn("all", F.lit(0)))
    n, distinct = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    ranked = numbered(rows, ["all"], same, "copies", max(1, int(distinct**0.5)))
    last = F.col("rank") + F.col("copies") - 1
    stretches = ranked.select(
        "doc_id", "size", "text_crc32", last.alias("last"),
        F.explode(F.sequence("rank", last, F.lit(UNFOLD).cast("long"))).alias("from"),
    ).repartition("from")
    unfolded = stretches.select(
        "doc_id", "size", "text_crc32",
        F.explode(F.sequence("from", F.least("last", F.col("from") + UNFOLD - 1))).alias("row_number"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permute(batch.column(3).to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)],
                [*batch.schema.names, "shard", "slot"],
            )

    return unfolded.mapInArrow(
        run, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long"
    )
