"""Keyed upserts without a merge-capable table format (WIN1, SNK1-7, INC2-4).

The reference replaces rows on primary-key conflict in arrival order. Here a
snapshot is the *keep-last* reduction of everything that ever arrived:

    keep_last(existing UNION ALL batch, key, order)

implemented as ``groupBy(key).agg(max_by(struct(row), order))``. Because
``max_by`` is an ordinary aggregate it is partially evaluated on the map
side: a key that received millions of versions still ships one row per map
task to the shuffle, unlike a ``row_number()`` window that would pull every
version of a hot key into one task.

Idempotence: re-applying a batch yields the same snapshot, since the batch's
rows either win again with the same values or lose to newer ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegerType, LongType, NumericType, TimestampNTZType, TimestampType

from keelson.schemas import KEYS

#: Types of which hash aggregation keeps a value in place.
FIXED_WIDTH = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the row with the greatest ``order`` tuple.

    ``order`` must be unique within a key (append a sequence column) so that
    the winner is deterministic. Where all other columns have a fixed width and
    one whole number orders them, each is kept beside it, which is hashed and not
    sorted; all columns still come from one row.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    types = {f.name: f.dataType for f in df.schema}
    whole = len(order) == 1 and isinstance(types.get(order[0]), (IntegerType, LongType))
    if whole and payload and all(isinstance(types[c], FIXED_WIDTH) and getattr(types[c], "precision", 0) <= 18 for c in payload):
        at = F.coalesce(F.col(order[0]).cast("long"), F.lit(-(2**63)))  # nulls come first
        return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in payload]).select(*keys, *payload)
    winner = F.max_by(F.struct(*payload), F.struct(*order)).alias("w")
    return df.groupBy(*keys).agg(winner).select(*keys, "w.*")


def upsert(existing: DataFrame | None, batch: DataFrame, entity: str, seq: str = "arrival_seq") -> DataFrame:
    """Merged snapshot of ``entity`` after applying ``batch`` on ``existing``.

    Later ``seq`` wins (last-write-wins in arrival order, not newest
    ``updated_at``). The returned snapshot keeps ``seq`` so it can be merged again.
    """
    rows = batch if existing is None else existing.unionByName(batch, allowMissingColumns=True)
    return keep_last(rows, KEYS[entity], [seq])


def evolve(df: DataFrame, columns: Sequence[str], defaults: dict, types: dict | None = None) -> DataFrame:
    """Bring rows written under an older layout to the current one (SNK14):
    missing columns are added and NULLs in added columns take their defaults.
    Use with ``spark.read.option("mergeSchema", True)`` over mixed-layout files."""
    out = df
    for name in columns:
        if name not in out.columns:
            dtype = (types or {}).get(name)
            out = out.withColumn(name, F.lit(None).cast(dtype) if dtype else F.lit(None))
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out.select(*columns)
