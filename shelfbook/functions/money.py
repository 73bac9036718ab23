"""Decimal types and the rounding used for money: half away from zero, always at a stated scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"
PRICE = "decimal(10,2)"
RATE = "decimal(5,4)"


def money(value: Column | str | int) -> Column:
    """A column or literal at two decimals."""
    column = F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value
    return column.cast(MONEY)


def zero() -> Column:
    return money(0)


def or_zero(column: Column | str) -> Column:
    return F.coalesce(money(column), zero())


def total(column: Column | str) -> Column:
    """Sum at two decimals; NULL when nothing was summed, as in SQL."""
    return F.sum(column).cast(MONEY)


def discounted(price: Column, percent: Column) -> Column:
    return money(price * (F.lit(100) - percent) * F.lit("0.01").cast("decimal(3,2)"))


def undiscounted(price: Column, percent: Column) -> Column:
    return money(price * F.lit(100) / (F.lit(100) - percent))


def is_true(flag: Column | str) -> Column:
    """SQL ``IS TRUE``: an unknown flag counts as false."""
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))
