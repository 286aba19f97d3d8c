"""Helpers of the operators that start small Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 50_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if a bounded count shows at most ``rows`` rows; otherwise as it
    is, for a shuffled join whose skewed partitions Spark splits. For narrow tables that are already
    written: the count is a job of its own."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
