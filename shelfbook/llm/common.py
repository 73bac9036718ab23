"""What the training-data operators share: tables, word rules and batch sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII blanks.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many leading underscores as keep it apart from ``taken``, in whatever case."""
    used, found = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def small_batches(df: DataFrame, rows: int = 500, size: int | None = None) -> DataFrame:
    """Have Arrow carry few rows at a time to Python, as one row may hold a very long text; ``size`` bounds their bytes too."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df
