"""Joins that look at a side's size before they broadcast it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Sides of joins with at most so many rows are broadcast; they have a few short columns.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it to have at most ``rows`` rows, else as it is."""
    return df.hint("broadcast") if df.limit(rows + 1).count() <= rows else df
