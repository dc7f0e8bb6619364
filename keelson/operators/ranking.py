"""Places of rows in their groups where one group may be larger than any task.

``row_number()`` over a group sorts it in one task. Here rows are sorted in
ranges of (group, order), so a hot group lies in many ranges; a row's place is
the rows of its group in earlier ranges (a prefix sum over one count for each
range of each group) plus its place in its own range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.session import checkpoint_dir


def _in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows sorted in ranges, with ``_range`` and ``_at``, written once: ranges are only fixed by what was written."""
    checkpoint_dir(df.sparkSession)
    by = [*group, *order]
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint()


def _with_earlier(placed: DataFrame, group: Sequence[str], total: Column, **more: Column) -> DataFrame:
    """``placed`` with ``_before``: the ``total`` of the row's group in earlier ranges; ``more``: of its own range."""
    pieces = placed.groupBy(*group, "_range").agg(total.alias("_n"), *[c.alias(n) for n, c in more.items()])
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), *more,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(offsets, same)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each group by ``order``.

    ``order`` should tell the rows of a group apart. Nulls are keys and come first.
    """
    joined = _with_earlier(_in_ranges(df, group, order), group, F.count("*"), _first=F.min("_at"))
    place = (F.col("_before") + F.col("_at") - F.col("_first")).cast("long")
    return joined.select(*df.columns, place.alias(name))


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of the whole number ``weight`` over the group's rows up to and with this one."""
    joined = _with_earlier(_in_ranges(df, group, order), group, F.sum(weight))
    inside = W.partitionBy(*group, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.select(*df.columns, (F.col("_before") + F.sum(weight).over(inside)).cast("long").alias(name))
