"""Orders, daily figures and line pricing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import discounted, is_true, money, or_zero, total, undiscounted
from .entries import PAID, PREPAID


def on_day(column: str, day: dt.date) -> Column:
    """The timestamp falls on the day, as a range the Parquet scan can use to skip row groups."""
    start = F.lit(day.isoformat()).cast("timestamp_ntz")
    end = F.lit((day + dt.timedelta(days=1)).isoformat()).cast("timestamp_ntz")
    return (F.col(column) >= start) & (F.col(column) < end)


def order_totals(lines: DataFrame) -> DataFrame:
    """Subtotal, tax and total per order that has lines."""
    return lines.groupBy("order_id").agg(
        total("total_price").alias("subtotal"),
        money(F.coalesce(F.sum("tax_amount"), F.lit(0))).alias("tax"),
        money(F.sum("total_price") + F.coalesce(F.sum("tax_amount"), F.lit(0))).alias("total"),
    )


def totals_of(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Totals of these orders only; lines of other orders are left out before the sum."""
    return order_totals(lines.join(orders.select("order_id"), "order_id", "left_semi"))


def open_orders(orders: DataFrame, lines: DataFrame, location_id: int | None = None) -> DataFrame:
    """Orders still at the till with their totals, oldest first within a location."""
    at_till = orders.filter((F.col("order_type") == "order") & (F.col("order_status") == "pos"))
    if location_id is not None:
        at_till = at_till.filter(F.col("location_id") == location_id)
    return (
        at_till.join(totals_of(at_till, lines), "order_id", "left")
        .select("order_id", "location_id", "customer_id", "created_ts", "total")
        .orderBy("location_id", "created_ts")
    )


def closed_orders(orders: DataFrame, column: str, day: dt.date) -> DataFrame:
    return orders.filter(
        (F.col("order_type") == "order") & (F.col("order_status") == "closed") & on_day(column, day)
    )


def closed_orders_on(
    orders: DataFrame, lines: DataFrame, day: dt.date, location_id: int | None = None
) -> DataFrame:
    """Orders closed on a day with their totals, newest first within a location."""
    kept = closed_orders(orders, "order_ts", day)
    if location_id is not None:
        kept = kept.filter(F.col("location_id") == location_id)
    return (
        kept.join(totals_of(kept, lines), "order_id", "left")
        .select("order_id", "location_id", "customer_id", "created_ts", "total")
        .orderBy("location_id", F.desc("created_ts"))
    )


def sales_by_location(orders: DataFrame, lines: DataFrame, locations: DataFrame, day: dt.date) -> DataFrame:
    """Subtotal, tax and total per location of the orders closed on a day."""
    that_day = closed_orders(orders, "close_ts", day).select("order_id", "location_id")
    per_location = (
        lines.join(that_day, "order_id")
        .groupBy("location_id")
        .agg(F.sum("total_price").alias("_price"), F.coalesce(F.sum("tax_amount"), F.lit(0)).alias("_tax"))
    )
    return (
        per_location.join(locations, "location_id")
        .groupBy(F.col("name").alias("location_name"))
        .agg(
            total("_price").alias("subtotal"),
            total("_tax").alias("tax"),
            total(F.col("_price") + F.col("_tax")).alias("total"),
        )
        .orderBy("location_name")
    )


def payment_class() -> Column:
    prepaid = is_true("store_credit") | is_true("gift_card")
    return F.when(prepaid, PREPAID).otherwise(PAID)


def payments_by_class(payments: DataFrame, methods: DataFrame, day: dt.date) -> DataFrame:
    """Payments processed on a day: prepaid (store credit, gift cards) against everything else."""
    kinds = methods.select("payment_method_id", "store_credit", "gift_card")
    # Summed per method first, so that five rows at most meet the method table.
    per_method = (
        payments.filter(on_day("process_ts", day)).groupBy("payment_method_id").agg(F.sum("amount").alias("_sum"))
    )
    return (
        per_method.join(kinds, "payment_method_id")
        .groupBy(payment_class().alias("type"))
        .agg(total("_sum").alias("total"))
        .orderBy("type")
    )


def with_grand_total(df: DataFrame, labels: list[str], measures: list[str]) -> DataFrame:
    """The rows plus one row of column sums, flagged ``is_total``, in one pass.

    An extra row without values makes the total appear even when there is nothing to report.
    """
    columns = [*labels, *measures]
    empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns]
    extra = df.sparkSession.range(1).select(*empty, F.lit(False).alias("_real"))
    return (
        df.select(*columns, F.lit(True).alias("_real"))
        .unionByName(extra)
        .groupingSets([[F.col(c) for c in labels], []], *labels)
        .agg(
            *[total(m).alias(m) for m in measures],
            (F.grouping_id() > 0).alias("is_total"),
            F.bool_or("_real").alias("_real"),
        )
        .filter(F.col("is_total") | F.col("_real"))
        .select(*columns, "is_total")
    )


def order_balance_due(orders: DataFrame, totals: DataFrame, paid: DataFrame) -> DataFrame:
    """Order total less payments taken, for orders with and without payments.

    ``paid`` comes from ``balances.paid_per_order``. The flags tell whether the order has any lines
    and any payments.
    """
    return (
        orders.join(totals.select("order_id", "total"), "order_id", "left")
        .join(paid, "order_id", "left")
        .select(
            "order_id", "customer_id", "order_status", "discount",
            or_zero("total").alias("total"), or_zero("paid").alias("paid"),
            money(or_zero("total") - or_zero("paid")).alias("balance_due"),
            "store_credit_payments",
            F.col("total").isNotNull().alias("has_lines"),
            F.col("paid").isNotNull().alias("has_payments"),
        )
    )


def apply_order_discount(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Discount every item line of the requested orders (order_id, percent).

    Of several requests for an order the largest discount counts.
    """
    asked = requests.groupBy("order_id").agg(F.max("percent").alias("percent"))
    hit = F.col("percent").isNotNull() & F.col("item_id").isNotNull()
    return lines.join(asked, "order_id", "left").select(
        "order_id", "line_number", "item_id",
        F.when(hit, discounted(F.col("unit_price"), F.col("percent")))
        .otherwise(money("unit_price")).alias("unit_price"),
        F.when(hit, F.lit(True)).otherwise(F.col("discounted")).alias("discounted"),
    )


def orders_discounted(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """Orders with the discount of their request (order_id, percent), the largest of several."""
    asked = requests.groupBy("order_id").agg(F.max("percent").alias("_percent"))
    return orders.join(asked, "order_id", "left").select(
        "order_id", F.coalesce("_percent", "discount").cast("int").alias("discount")
    )


def orders_without_discount(orders: DataFrame) -> DataFrame:
    """Orders with the discount of open ones cleared."""
    cleared = F.col("close_ts").isNull() & (F.col("discount") > 0)
    return orders.select("order_id", F.when(~is_true(cleared), F.col("discount")).cast("int").alias("discount"))


def remove_order_discount(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Undo the discount of open orders on all their item lines, marked as discounted or not."""
    given = orders.filter(F.col("close_ts").isNull() & (F.col("discount") > 0)).select(
        "order_id", F.col("discount").alias("percent")
    )
    hit = F.col("percent").isNotNull() & F.col("item_id").isNotNull()
    return lines.join(given, "order_id", "left").select(
        "order_id", "line_number", "item_id",
        F.when(hit, undiscounted(F.col("unit_price"), F.col("percent")))
        .otherwise(money("unit_price")).alias("unit_price"),
        F.when(~hit, F.col("discounted")).alias("discounted"),
    )


def toggle_line_discount(lines: DataFrame, orders: DataFrame, flag: Column) -> DataFrame:
    """Add or remove the order's discount on single lines; ``flag`` gives 'add' or 'remove' per line.

    Only lines without the mark can be added and only marked lines removed.
    """
    given = orders.filter(F.col("close_ts").isNull() & (F.col("discount") > 0)).select(
        "order_id", F.col("discount").alias("percent")
    )
    on = is_true((flag == "add") & F.col("percent").isNotNull() & F.col("discounted").isNull())
    off = is_true((flag == "remove") & F.col("percent").isNotNull() & F.col("discounted"))
    return lines.withColumn("flag", flag).join(given, "order_id", "left").select(
        "order_id", "line_number", "flag",
        F.when(on, discounted(F.col("unit_price"), F.col("percent")))
        .when(off, undiscounted(F.col("unit_price"), F.col("percent")))
        .otherwise(money("unit_price")).alias("unit_price"),
        F.when(on, F.lit(True)).when(~off, F.col("discounted")).alias("discounted"),
    )


def price_sale_lines(entered: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Price scanned lines: the entered price, else the item's, else zero, less the order's discount.

    A price or quantity of zero counts as not entered. Lines of unknown items are left out.
    """
    stock = items.select("item_id", F.col("unit_price").alias("item_price"))
    head = orders.select("order_id", F.col("discount").alias("percent"))
    none = F.lit(0)
    price = F.coalesce(F.nullif(F.col("unit_price"), none), F.nullif(F.col("item_price"), none), none)
    less = F.coalesce(F.col("percent") > 0, F.lit(False))
    return (
        entered.join(stock, "item_id")
        .join(head, "order_id")
        .select(
            "order_id", "line_number", "item_id",
            F.lit("item").alias("item_type"),
            F.coalesce(F.nullif(F.col("qty"), none), F.lit(1)).cast("int").alias("qty"),
            F.when(less, discounted(money(price), F.col("percent"))).otherwise(money(price)).alias("unit_price"),
            F.when(less, F.lit(True)).alias("discounted"),
        )
    )


def reject_invalid_items(entered: DataFrame, items: DataFrame) -> DataFrame:
    """Entered lines whose item does not exist."""
    return entered.filter(F.col("item_id").isNotNull()).join(items.select("item_id"), "item_id", "left_anti")


def close_orders(orders: DataFrame, ready: DataFrame, at: Column) -> DataFrame:
    """Close the listed orders at a given time."""
    marked = orders.join(ready.select("order_id").distinct().withColumn("_now", F.lit(True)), "order_id", "left")
    now = is_true("_now")
    return marked.select(
        "order_id", "customer_id", "location_id",
        F.when(now, F.lit("order")).otherwise(F.col("order_type")).alias("order_type"),
        F.when(now, F.lit("closed")).otherwise(F.col("order_status")).alias("order_status"),
        F.when(now, at).otherwise(F.col("order_ts")).alias("order_ts"),
        F.when(now, at).otherwise(F.col("close_ts")).alias("close_ts"),
    )


def drop_orders(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Take the listed orders out of every table that holds an ``order_id``."""
    gone = ids.select("order_id")
    return {name: table.join(gone, "order_id", "left_anti") for name, table in tables.items()}


def remove_lines(lines: DataFrame, doomed: DataFrame) -> DataFrame:
    """Delete the listed lines (order_id, line_number)."""
    return lines.join(doomed.select("order_id", "line_number"), ["order_id", "line_number"], "left_anti")


def remove_unprocessed_payments(payments: DataFrame, doomed: DataFrame) -> DataFrame:
    """Delete the listed payments of an order unless they were processed."""
    marks = doomed.select("order_id", "order_payment_id").withColumn("_doomed", F.lit(True)).distinct()
    kept = payments.join(marks, ["order_id", "order_payment_id"], "left")
    return kept.filter(F.col("_doomed").isNull() | F.col("customer_payment_id").isNotNull()).drop("_doomed")


def order_worklist(positions: DataFrame, walk_in: DataFrame) -> DataFrame:
    """What can be done next with each open order.

    ``positions`` comes from ``order_credit_position`` with the columns of ``WORKLIST_COLUMNS`` kept;
    ``walk_in`` holds the cash customer's id.
    """
    anonymous = walk_in.select("customer_id", F.lit(True).alias("_walk_in"))
    due = F.col("order_balance") != 0
    return (
        positions.filter(F.col("order_status") == "pos")
        .join(anonymous, "customer_id", "left")
        .select(
            "order_id", "order_balance",
            (F.col("has_lines") & due).alias("can_pay"),
            (F.col("has_payments") & ~due).alias("can_close"),
            (F.col("has_lines") & (F.coalesce("discount", F.lit(0)) == 0)).alias("can_discount"),
            (~is_true("_walk_in") & (F.col("gl_credit_balance") < 0)).alias("owes_account"),
            (~F.col("has_lines")).alias("can_apply_gift"),
        )
    )


WORKLIST_COLUMNS = ("order_status", "discount", "has_lines", "has_payments")
