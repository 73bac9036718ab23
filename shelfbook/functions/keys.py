"""Ids and running totals that stay distributed however uneven the keys are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .money import MONEY

# Rows of a slice. Counted, since the rows' compressed size tells little of the memory a sort of them takes.
SLICE_ROWS = 250_000


def running_totals(
    df: DataFrame,
    order_by: Sequence[str],
    sums: dict[str, str],
    group_by: Sequence[str] = (),
    kind: str = MONEY,
) -> DataFrame:
    """Running sum of each ``sums[out] = column`` within ``group_by`` in ``order_by`` order.

    A window partitioned by the group alone would put a busy group into one task. Here the rows are
    cut into ordered slices of even size that may divide a group, each slice is summed once, and
    every row adds the sum of its group's earlier slices to its running sum inside the slice.
    ``order_by`` must be unique within a group. The rows are pinned because they are counted, sampled and cut, the slices
    because they are read twice. Up to ``SLICE_ROWS`` rows are cut as Spark sees fit, more into slices of that many.
    """
    group_by, order_by = list(group_by), list(order_by)
    df = pin(df)
    rows = df.count()
    number = [max(-(-rows // SLICE_ROWS), df.sparkSession.sparkContext.defaultParallelism)] if rows > SLICE_ROWS else []
    cut = pin(df.repartitionByRange(*number, *group_by, *order_by).withColumn("_slice", F.spark_partition_id()))
    # One row per slice and group: at most (number of slices + number of groups) rows.
    slices = cut.groupBy("_slice", *group_by).agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*group_by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        F.col("_slice").alias("_start_slice"),
        *[F.col(g).alias(f"_g_{g}") for g in group_by],
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
    )
    same = F.col("_slice") == F.col("_start_slice")
    for g in group_by:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = (
        Window.partitionBy("_slice", *group_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    )
    if number:
        cut = cut.repartition(*number, "_slice")  # a fixed number of tasks, which AQE doesn't pack
    summed = cut.withColumns({f"_t_{o}": F.sum(c).over(inside) for o, c in sums.items()})
    return summed.join(starts, same).select(
        *df.columns, *[(F.col(f"_b_{o}") + F.col(f"_t_{o}")).cast(kind).alias(o) for o in sums]
    )


def number_rows(df: DataFrame, order_by: Sequence[str], out: str) -> DataFrame:
    """Consecutive numbers from 1 over the whole frame, without a single-task window."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), order_by, {out: "_one"}, kind="bigint")
    return counted.drop("_one")


def next_ids(existing: DataFrame, key: str, new: DataFrame, order_by: Sequence[str], out: str) -> DataFrame:
    """Give each new row the next free id after the highest existing one."""
    highest = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    numbered = number_rows(new, order_by, "_n")
    return numbered.withColumn(out, highest + F.col("_n")).drop("_n")
