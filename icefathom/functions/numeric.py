"""Small numeric expressions shared by operators and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int = 3) -> Column:
    """Value on a fixed decimal grid, half up, never minus zero."""
    unit = 10.0**digits
    return F.floor(value * unit + 0.5) / unit


# Fixed value: cell of rows without a position.
NO_CELL = -(2**40)


def cell_index(value: Column, size: float) -> Column:
    """Index of the grid cell a coordinate falls in."""
    return F.floor(value / F.lit(float(size))).cast("bigint")


def join_cell(value: Column, size: Column | float) -> Column:
    """Cell index used as a join key, never null.

    A nullable key makes the optimizer push a null test below the projection
    and evaluate the whole coordinate formula again there; drop rows without
    a position before the join instead.
    """
    return F.coalesce(F.floor(value / size).cast("bigint"), F.lit(NO_CELL))


def clamp(value: Column, low: float, high: float) -> Column:
    """Value cut to [low, high]; null stays null (least and greatest skip it)."""
    return F.when(value < low, F.lit(float(low))).when(value > high, F.lit(float(high))).otherwise(value)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double, also for zone-free timestamps."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6
