"""Sizes that are looked at before a side of a join is sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most that many rows (counted as far as needed), else as it is: the planner then
    shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
