"""Multi-step jobs: closing sales, paying vendors, the day's dashboard and the date repair."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import next_ids
from ..functions.money import is_true
from ..operators import ledger, payments, payouts, repairs, sales
from ..session import pin

# Fixed value: why an order is refused.
MUST_BALANCE = "Need to balance till first"


class ClosedSales(NamedTuple):
    """The tables a closing run writes."""

    orders: DataFrame
    invoices: DataFrame
    lines: DataFrame
    payments: DataFrame
    order_payments: DataFrame
    allocations: DataFrame
    postings: DataFrame
    tills: DataFrame
    rejected: DataFrame


def unbalanced_orders(pending: DataFrame, orders: DataFrame, tills: DataFrame) -> DataFrame:
    """Orders with a till payment at a location whose till has no balance yet."""
    rung = pending.filter(is_true("till_method")).select("order_id").distinct()
    return (
        orders.select("order_id", "location_id")
        .join(rung, "order_id", "left_semi")
        .join(tills.select("location_id"), "location_id", "left_anti")
        .select("order_id", "location_id", F.lit(MUST_BALANCE).alias("reason"))
    )


def close_sales(
    ready: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    order_payments: DataFrame,
    taken_payments: DataFrame,
    taken_invoices: DataFrame,
    consignors: DataFrame,
    methods: DataFrame,
    tills: DataFrame,
    at: Column,
    taken_tills: DataFrame | None = None,
) -> ClosedSales:
    """Close all ready orders (order_id) in one run.

    Duplicate payments are merged, invoices made and posted, payments processed, posted and allocated,
    tills carried forward, and the orders marked closed. Order payments are linked to what was made of them, payments
    to the till row they gave; till rows are numbered after ``taken_tills`` (else after ``tills``). Orders with till payments at a location without an opening
    balance are refused as a whole (``rejected``).
    """
    asked = orders.join(ready.select("order_id"), "order_id", "left_semi")
    # What several steps read is pinned, so that it is made once and no task holds the sorts of all steps before it.
    merged = pin(payments.payments_after_merge(
        order_payments.join(ready.select("order_id"), "order_id", "left_semi"), methods
    ))
    rejected = pin(unbalanced_orders(payments.payments_to_process(merged, methods), asked, tills))
    ready = ready.select("order_id").join(rejected, "order_id", "left_anti")
    closing = pin(asked.join(rejected, "order_id", "left_anti"))
    invoices = next_ids(
        taken_invoices, "invoice_id", closing.select("order_id", "customer_id"), ["order_id"], "invoice_id"
    ).withColumn("created_ts", at)
    billed = ledger.bill_lines(lines.join(ready, "order_id", "left_semi"), invoices)
    merged = merged.join(rejected, "order_id", "left_anti")
    pending = payments.payments_to_process(merged, methods)
    processed = payments.customer_payments(pending, closing, taken_payments, at)
    paid = ledger.payment_entries(processed, methods)
    settled = payments.reclass_payment_postings(paid, processed, consignors)
    sold = ledger.post_invoices(billed, invoices, consignors)
    columns = ["trans_ref", "trans_ref_id", "ref", "ref_id", "account", "debit", "credit"]
    postings = sold.select(
        F.lit("invoice").alias("trans_ref"), F.col("invoice_id").alias("trans_ref_id"), *columns[2:]
    ).unionByName(
        settled.select(
            F.lit("customer_payment").alias("trans_ref"),
            F.col("customer_payment_id").alias("trans_ref_id"), *columns[2:],
        )
    )
    openings = tills.select("location_id", F.col("cash_balance").alias("opening_balance"))
    carried = next_ids(
        tills if taken_tills is None else taken_tills, "till_transaction_id",
        payments.till_running_balance(processed, methods, openings), ["customer_payment_id"], "till_transaction_id",
    )
    till_of = carried.select("customer_payment_id", "till_transaction_id")
    return ClosedSales(
        sales.close_orders(orders, ready, at),
        invoices,
        billed,
        processed.join(till_of, "customer_payment_id", "left"),
        payments.link_processed(merged, processed),
        payments.invoice_payments(processed, invoices),
        postings,
        carried,
        rejected,
    )


class PayoutRun(NamedTuple):
    candidates: DataFrame
    headers: DataFrame
    lines: DataFrame
    entries: DataFrame


def pay_vendors(
    postings: DataFrame, vendors: DataFrame, consignors: DataFrame, minimum: Decimal | str, pay_date: dt.date,
    run_date: dt.date,
) -> PayoutRun:
    """Candidates, vouchers and their postings for a pay date."""
    candidates = payouts.payout_candidates(postings, vendors, consignors, minimum, pay_date)
    lines = payouts.payout_voucher_lines(candidates, run_date)
    return PayoutRun(
        candidates,
        payouts.payout_voucher_headers(candidates, pay_date, run_date),
        lines,
        ledger.voucher_entries(lines),
    )


def dashboard(
    orders: DataFrame, lines: DataFrame, locations: DataFrame, paid: DataFrame, methods: DataFrame,
    sales_day: dt.date, payment_day: dt.date,
) -> tuple[DataFrame, DataFrame]:
    """The day's sales by location and payments by class, each with a total row."""
    sold = sales.sales_by_location(orders, lines, locations, sales_day)
    taken = sales.payments_by_class(paid, methods, payment_day)
    return (
        sales.with_grand_total(sold, ["location_name"], ["subtotal", "tax", "total"]),
        sales.with_grand_total(taken, ["type"], ["total"]),
    )


def repair_dates(repairs_needed: DataFrame, transactions: DataFrame) -> DataFrame:
    """Repost the ledger transactions behind repaired documents on their true date."""
    affected = repairs.affected_transactions(repairs_needed, transactions)
    dates = affected.select("trans_id", F.to_date("payment_date").alias("new_date"))
    return ledger.repost_with_new_date(transactions, dates)


def repair_dates_balanced(repairs_needed: DataFrame, transactions: DataFrame, postings: DataFrame) -> ledger.Posted:
    """The same, but transactions that do not balance stay open and are listed."""
    affected = repairs.affected_transactions(repairs_needed, transactions)
    return ledger.repost_balanced(transactions, affected.select("trans_id", F.to_date("payment_date").alias("new_date")), postings)
