"""Bitmaps over cells of 64-bit hashes: filled by Spark, collected under a bound, and asked by all tasks.

A hash has ``HASHES`` cells among a power of two. The driver and each task hold one bit a cell, ``MOST`` cells (32 MB) at
most; with more hashes than that suits, more strangers pass, and what must be exact is decided behind the filter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASHES = 4
LEAST, MOST = 1 << 16, 1 << 28
_BLOCK = 1 << 15  # cells of a bitmap of Spark's aggregate


def size_for(count: int, cells: int, most: int = MOST) -> int:
    """Cells for ``count`` hashes, ``cells`` or more for each as far as ``most`` allows; a power of two."""
    return min(max(LEAST, 1 << max(0, cells * count - 1).bit_length()), most)


def cells_of(hashed: Column, size: int) -> list[Column]:
    """A hash's cells; all but the first step by an odd number."""
    first = hashed.bitwiseAND(F.lit((1 << 31) - 1))
    step = F.shiftrightunsigned(hashed, 33).bitwiseOR(F.lit(1))
    return [(first + i * step).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)]


def counted(hashes: DataFrame, size: int) -> DataFrame:
    """(cell, n) of the cells that the ``hash`` column points at; tasks count for themselves first."""
    return hashes.select(F.explode(F.array(*cells_of(F.col("hash"), size))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def collect(cells: DataFrame, size: int) -> np.ndarray:
    """The bits of all ``cell`` numbers, packed low bit first."""
    placed = cells.select(F.expr(f"cell div {_BLOCK}").alias("block"), (F.col("cell") % _BLOCK).alias("bit"))
    bits = np.zeros(size // 8, np.uint8)
    for row in placed.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[row.block * _BLOCK // 8 :][: _BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def all_set(bits: np.ndarray, hashed: Column, spark: SparkSession) -> Column:
    """Whether all cells of a hash are set."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def asked(*cells: pd.Series) -> pd.Series:
        found = np.ones(len(cells[0]), bool)
        for cell in cells:
            at = cell.to_numpy()
            found &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return asked(*cells_of(hashed, 8 * len(bits)))
