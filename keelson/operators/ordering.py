"""Order of list-shaped outputs as a column (SRT2, SRT4, SRT7, SRT9).

A result is a set of rows; where a reader wants each repository's list in a
given order, a position says it without a global sort. Meant for lists that are
short by nature (months, cohorts, entities, top-k rows of a repository).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators.kpis import REPO


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``position``: the row's place, from 0, in its repository's list."""
    place = F.row_number().over(W.partitionBy(REPO).orderBy(*order)) - 1
    return df.withColumn("position", place.cast("long"))
