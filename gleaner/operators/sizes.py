"""Checks of size before a table is broadcast, collected or multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast, and of a dimension that becomes part of a plan.
BROADCAST_ROWS, DIMENSION_ROWS = 200_000, 10_000


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if its counted rows are few; else a join with it is a shuffle join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def dimension(table: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """The table, if it is small enough for a plan to hold it whole."""
    if (n := table.limit(most + 1).count()) > most:
        raise ValueError(f"a dimension of at most {most} rows is wanted here, this one has more ({n})")
    return table
