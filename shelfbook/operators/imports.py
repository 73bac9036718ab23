"""Bulk sales import: one order per batch, its lines, and the headers that close it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import PRICE
from ..functions.pairing import theta_join


def import_sales_lines(orders: DataFrame, shipping: DataFrame, sales: DataFrame) -> DataFrame:
    """Non-zero staged sales as lines of their batch's import order.

    A batch has one import order, so the batch name joins sales to it and no pairing of every order
    with every sale is needed.
    """
    importing = orders.filter((F.col("order_type") == "pos") & (F.col("order_status") == "import"))
    heads = importing.select("batch", "order_id", "location_id").join(
        shipping.select("order_id", "ship_id"), "order_id"
    )
    return (
        sales.filter(F.col("amount") != 0)
        .join(heads, "batch")
        .select(
            "order_id", F.lit("item").alias("item_type"), "ship_id",
            F.col("location_id").alias("pt_location_id"), F.lit(1).alias("qty"),
            F.col("amount").cast(PRICE).alias("unit_price"), F.col("ct_consign_id").alias("item_id"),
        )
    )


def import_all_sales(orders: DataFrame, shipping: DataFrame, sales: DataFrame) -> DataFrame:
    """Every non-zero staged sale as a line of every import order, for lists that name no batch.

    ``sales`` (ct_consign_id, amount). Usually one order is being imported; however many there are, both sides are counted
    and paired in a grid whose cells are of a bounded size.
    """
    importing = orders.filter((F.col("order_type") == "pos") & (F.col("order_status") == "import"))
    heads = importing.select("order_id", "location_id").join(shipping.select("order_id", "ship_id"), "order_id")
    staged = sales.select("ct_consign_id", "amount")
    return theta_join(staged, heads, F.col("amount") != 0).select(
        "order_id", F.lit("item").alias("item_type"), "ship_id",
        F.col("location_id").alias("pt_location_id"), F.lit(1).alias("qty"),
        F.col("amount").cast(PRICE).alias("unit_price"), F.col("ct_consign_id").alias("item_id"),
    )


def import_order_headers(orders: DataFrame, locations: DataFrame, invoice_ts: str, close_ts: str) -> DataFrame:
    """Shipping address, invoice date and closing state of each import order."""
    made, closed = F.lit(invoice_ts).cast("timestamp_ntz"), F.lit(close_ts).cast("timestamp_ntz")
    importing = orders.filter((F.col("order_type") == "pos") & (F.col("order_status") == "import"))
    return importing.join(locations.select("location_id", "state", "zipcode"), "location_id").select(
        "order_id", "location_id",
        F.lit(0).cast(PRICE).alias("ship_cost"), "state", "zipcode",
        made.alias("invoice_created_ts"),
        F.lit("order").alias("order_type"), F.lit("closed").alias("order_status"),
        closed.alias("order_ts"), closed.alias("close_ts"),
    )
