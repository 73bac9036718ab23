"""Paying consignors: payout runs, vouchers, manual adjustments and account conversion."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import is_true, money, or_zero, total
from .balances import vendor_cash_balance
from .entries import (
    CASH_ADJUSTED, CONSIGNOR, COST, CREDIT_ADJUSTED, PAYABLE, PAYOUT, PAYOUT_OFFSET, TRANSFER, credit, debit, emit,
)
from .sales import with_grand_total


def _payable(postings, vendors, consignors, minimum, pay_date, with_ap: bool) -> DataFrame:
    """Candidates from a single sum over the ledger, with open payables on request."""
    side = F.col("ref").isin("vendor", "customer")
    early = side & (F.col("account") == CONSIGNOR) & (F.col("post_date") < F.lit(pay_date))
    open_ap = (F.col("ref") == "vendor") & (F.col("account") == PAYABLE) & F.col("post_date").isNotNull()
    value = F.col("credit") - F.col("debit")
    linked = consignors.filter(F.col("vendor_id").isNotNull() & F.col("customer_id").isNotNull()).select(
        F.lit("customer").alias("ref"), F.col("customer_id").alias("ref_id"), F.col("vendor_id").alias("_linked")
    )
    sums = (
        postings.filter(early | open_ap if with_ap else early)
        .groupBy("ref", "ref_id")
        .agg(total(F.when(early, value)).alias("balance"), total(F.when(open_ap, value)).alias("ap"))
        .join(linked, ["ref", "ref_id"], "left")
    )
    vendor = F.col("ref") == "vendor"
    debt = ~vendor & (F.col("balance") < 0)
    return (
        sums.groupBy(F.when(vendor, F.col("ref_id")).otherwise(F.col("_linked")).alias("vendor_id"))
        .agg(
            F.max(F.when(vendor, F.col("balance"))).alias("earned"),
            F.max(F.when(debt, F.col("balance"))).alias("credit_balance"),
            F.max(F.when(debt, F.col("ref_id"))).alias("customer_id"),
            F.max(F.when(vendor & (F.col("ap") != 0), F.col("ap"))).alias("ap_amount"),
        )
        .withColumn("amount", money(F.col("earned") + or_zero("credit_balance")))
        .filter(F.col("amount") > F.lit(str(minimum)).cast("decimal(20,2)"))
        .join(vendors.select("vendor_id", "name"), "vendor_id")
    )


def payout_candidates(
    postings: DataFrame, vendors: DataFrame, consignors: DataFrame, minimum: Decimal | str, pay_date: dt.date
) -> DataFrame:
    """Vendors whose balance before the pay date, less any debt as a customer, is above the minimum."""
    payable = _payable(postings, vendors, consignors, minimum, pay_date, with_ap=False)
    return payable.select("vendor_id", "name", "amount", "credit_balance", "customer_id").orderBy("name")


def payout_review(
    postings: DataFrame, vendors: DataFrame, consignors: DataFrame, minimum: Decimal | str, pay_date: dt.date
) -> DataFrame:
    """Candidates with their open payables and a total row; payables should be zero before a run."""
    payable = _payable(postings, vendors, consignors, minimum, pay_date, with_ap=True)
    return with_grand_total(payable, ["vendor_id", "name", "ap_amount"], ["amount"])


def voucher_number(vendor_id: Column, run_date: dt.date) -> Column:
    return F.concat_ws("-", vendor_id.cast("string"), F.lit(run_date.isoformat()))


def payout_voucher_headers(candidates: DataFrame, pay_date: dt.date, run_date: dt.date) -> DataFrame:
    """One voucher per candidate, dated the day before the pay date."""
    return candidates.select(
        "vendor_id",
        F.date_sub(F.lit(pay_date), 1).alias("voucher_date"),
        voucher_number(F.col("vendor_id"), run_date).alias("ref_num"),
        F.lit("new").alias("voucher_status"),
    )


def payout_voucher_lines(candidates: DataFrame, run_date: dt.date) -> DataFrame:
    """One line per voucher, or two where a customer debt is set off against the vendor's balance."""
    def line(number, text, ref, ref_id, cost):
        return F.struct(
            F.lit(number).alias("line_number"), F.lit(text).alias("description"), F.lit(ref).alias("ref"),
            ref_id.cast("bigint").alias("ref_id"), F.lit(CONSIGNOR).alias("account"), F.lit(1).alias("qty"),
            money(cost).alias("unit_cost"),
        )

    offset = or_zero("credit_balance")
    lines = F.array_compact(
        F.array(
            line(1, PAYOUT, "vendor", F.col("vendor_id"), F.col("amount") - offset),
            F.when(
                offset != 0,
                line(2, PAYOUT_OFFSET, "customer", F.col("customer_id"), offset),
            ),
        )
    )
    return candidates.select(
        "vendor_id", voucher_number(F.col("vendor_id"), run_date).alias("ref_num"), F.explode(lines).alias("_l")
    ).select("vendor_id", "ref_num", "_l.*")


def single_payout(chosen: DataFrame, postings: DataFrame, run_date: dt.date) -> DataFrame:
    """A voucher line for the whole balance, posted or not, of each chosen account that has a vendor."""
    held = vendor_cash_balance(postings, posted_only=False)
    payable = chosen.filter(F.col("vendor_id").isNotNull()).select("ct_consign_id", "vendor_id")
    return payable.join(held, "vendor_id", "left").select(
        "ct_consign_id", "vendor_id",
        F.lit(run_date).alias("voucher_date"),
        voucher_number(F.col("vendor_id"), run_date).alias("ref_num"),
        F.lit(PAYOUT).alias("description"),
        F.lit("vendor").alias("ref"),
        F.col("vendor_id").alias("ref_id"),
        F.lit(CONSIGNOR).alias("account"),
        F.lit(1).alias("qty"),
        or_zero("balance").alias("unit_cost"),
    )


def manual_adjustment(adjustments: DataFrame, consignors: DataFrame) -> DataFrame:
    """Add cash to vendor accounts or credit to customer accounts, at cost.

    ``adjustments`` (ct_consign_id, kind 'cash' or 'credit', amount). Only accounts offering that
    kind take part: cash needs a cash account with a vendor, credit a credit account with a customer.
    """
    flag = is_true("cash")
    party = (
        F.when((F.col("kind") == "cash") & flag, F.col("vendor_id"))
        .when((F.col("kind") == "credit") & ~flag, F.col("customer_id"))
    )
    open_to_it = (
        adjustments.join(consignors.select("ct_consign_id", "cash", "vendor_id", "customer_id"), "ct_consign_id")
        .withColumn("party", party)
        .filter(F.col("party").isNotNull())
    )
    cash = F.col("kind") == "cash"
    ref = F.when(cash, "vendor").otherwise("customer")
    return emit(
        open_to_it,
        {
            "trans_ref": ref,
            "trans_ref_id": "party",
            "description": F.when(cash, CASH_ADJUSTED).otherwise(CREDIT_ADJUSTED),
        },
        credit(ref, F.col("party"), CONSIGNOR, F.col("amount")),
        debit(ref, F.col("party"), COST, F.col("amount")),
    )


def converted_balances(changes: DataFrame, postings: DataFrame, unchanged_counts_as_zero: bool = False) -> DataFrame:
    """Balances to move when accounts change between cash and credit, scaled by the change in rate.

    ``changes`` (ct_consign_id, vendor_id, customer_id, new_cash, old_percent, new_percent), with both
    ids filled where the account will need them. A rate gain of d multiplies the balance by 1 + d, a
    loss divides it by 1 + d. ``unchanged_counts_as_zero`` keeps the original's behaviour of taking a rate
    that was not edited as a new rate of zero.
    """
    to_cash = F.col("new_cash")
    old_ref = F.when(to_cash, "customer").otherwise("vendor")
    new_ref = F.when(to_cash, "vendor").otherwise("customer")
    old_id = F.when(to_cash, F.col("customer_id")).otherwise(F.col("vendor_id"))
    new_id = F.when(to_cash, F.col("vendor_id")).otherwise(F.col("customer_id"))
    held = (
        postings.filter((F.col("account") == CONSIGNOR) & F.col("ref").isin("vendor", "customer"))
        .groupBy("ref", "ref_id")
        .agg(total(F.col("credit") - F.col("debit")).alias("old_balance"))
        .select(F.col("ref").alias("old_ref"), F.col("ref_id").alias("old_id"), "old_balance")
    )
    entered = F.col("new_percent")
    if unchanged_counts_as_zero:
        entered = F.when(entered == F.col("old_percent"), F.lit(0)).otherwise(entered)
    rate = (entered - F.col("old_percent")).cast("decimal(6,4)")
    moved = (
        changes.select(
            "ct_consign_id", old_ref.alias("old_ref"), old_id.alias("old_id"), new_ref.alias("new_ref"),
            new_id.alias("new_id"), rate.alias("rate"),
        )
        .join(held, ["old_ref", "old_id"])
        .filter((F.col("old_balance") != 0) & F.col("new_id").isNotNull())
    )
    factor = (F.abs("rate") + 1).cast("decimal(7,4)")
    scaled = money(
        F.when(F.col("rate") > 0, F.col("old_balance") * factor).otherwise(F.col("old_balance") / factor)
    )
    return moved.withColumn("new_balance", scaled).withColumn(
        "difference", money(F.col("new_balance") - F.col("old_balance"))
    )


def convert_account_type(changes: DataFrame, postings: DataFrame, unchanged_counts_as_zero: bool = False) -> DataFrame:
    """The postings that move ``converted_balances``; the difference goes to cost."""
    return emit(
        converted_balances(changes, postings, unchanged_counts_as_zero),
        {
            "trans_ref": F.lit("ct_consign"),
            "trans_ref_id": "ct_consign_id",
            "description": F.lit(TRANSFER),
        },
        debit(F.col("old_ref"), F.col("old_id"), CONSIGNOR, F.col("old_balance")),
        credit(F.col("new_ref"), F.col("new_id"), CONSIGNOR, F.col("new_balance")),
        F.when(F.col("difference") != 0, debit(None, None, COST, F.col("difference"))),
    )


def conversion_log(converted: DataFrame) -> DataFrame:
    """(ct_consign_id, message) of every ``converted_balances`` row."""
    side = lambda ref: F.when(F.col(ref) == "vendor", "cash").otherwise("credit")
    text = lambda column: F.col(column).cast("string")
    return converted.select(
        "ct_consign_id",
        F.format_string(
            "Converted %s balance of %s to %s balance of %s (change of %s)",
            side("old_ref"), text("old_balance"), side("new_ref"), text("new_balance"), text("difference"),
        ).alias("message"),
    )
