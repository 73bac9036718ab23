"""Joins on a condition that is no equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin

CELL = 10_000  # rows of a side that meet in one cell of the grid


def _one_of(df: DataFrame, parts: int, out: str) -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))


def theta_join(left: DataFrame, right: DataFrame, condition: Column, cell: int = CELL) -> DataFrame:
    """All pairs of a row of ``left`` and one of ``right`` that meet the condition; column names must differ.

    The pairs form a grid: each side is counted and dealt to strips of about ``cell`` rows, a row goes to all cells of its
    strip, and the rows of a cell are compared with each other. A small right side is a single strip, which Spark broadcasts if
    its measured size allows that; no task holds more than a strip of each side.
    """
    left, right = pin(left), pin(right)
    high, wide = (max(1, -(-side.count() // cell)) for side in (left, right))
    rows = _one_of(left, high, "_high").withColumn("_wide", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    columns = _one_of(right, wide, "_wide").withColumn("_high", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    return rows.join(columns, ["_high", "_wide"]).filter(condition).drop("_high", "_wide")
