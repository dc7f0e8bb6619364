"""Final shaping shared by every registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType


def as_wall_clock(df: DataFrame) -> DataFrame:
    """Cast UTC ``timestamp`` columns to ``timestamp_ntz`` so exported values are
    plain UTC wall-clock times, independent of the reader's time zone."""
    cols = [
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, TimestampType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)
