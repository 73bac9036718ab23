"""Vendor checks: listing, voiding and turning a check into store credit."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import is_true
from .accounts import backfill_customers
from .entries import (
    CHECK_CONVERTED, CHECK_LOG, CHECK_VOIDED, CONSIGNOR, COST, VOID_MEMO, credit, debit, emit,
)


def or_zero_count(column: str):
    return F.coalesce(column, F.lit(0)).cast("bigint").alias(column)


def check_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.col("ref") == "check").select(
        F.col("ref_id").alias("check_id"), "trans_id", "post_date"
    )


def open_checks(checks: DataFrame, transactions: DataFrame, consignors: DataFrame) -> DataFrame:
    """Uncleared checks of consignors with the number of their ledger transactions."""
    mine = consignors.filter(F.col("vendor_id").isNotNull()).select("vendor_id")
    uncleared = checks.filter(F.col("cleared").isNull()).join(mine, "vendor_id", "left_semi")
    counted = check_transactions(transactions).groupBy("check_id").agg(F.count("*").alias("n_transactions"))
    return (
        uncleared.join(counted, "check_id", "left")
        .select("check_id", "vendor_id", "check_num", "check_date", "amount", or_zero_count("n_transactions"))
        .orderBy("vendor_id", "check_date", F.desc("check_id"))
    )


def open_check_transactions(checks: DataFrame, transactions: DataFrame, consignors: DataFrame) -> DataFrame:
    """The ledger transactions of uncleared checks of consignors, one row each."""
    mine = consignors.filter(F.col("vendor_id").isNotNull()).select("vendor_id")
    uncleared = checks.filter(F.col("cleared").isNull()).join(mine, "vendor_id", "left_semi")
    return check_transactions(transactions).join(uncleared, "check_id", "left_semi").select("check_id", "trans_id")


def find_check(
    checks: DataFrame, vendors: DataFrame, consignors: DataFrame, voucher_checks: DataFrame, numbers: DataFrame
) -> DataFrame:
    """Checks by number with payee, consignor and the number of vouchers they paid."""
    wanted = checks.join(numbers.select("check_num"), "check_num", "left_semi")
    counted = voucher_checks.groupBy("check_id").agg(F.count("*").alias("n_vouchers"))
    payee = vendors.select("vendor_id", F.col("name").alias("payee"))
    owner = consignors.select("vendor_id", "ct_consign_id", "customer_id", F.col("name").alias("consignor"))
    return (
        wanted.join(payee, "vendor_id")
        .join(owner, "vendor_id")
        .join(counted, "check_id", "left")
        .select(
            "check_id", "check_num", "check_date", "amount", "vendor_id", "customer_id", "ct_consign_id",
            "payee", "consignor", or_zero_count("n_vouchers"),
        )
    )


def found_check_vouchers(checks: DataFrame, voucher_checks: DataFrame, numbers: DataFrame) -> DataFrame:
    """The vouchers that the checks of these numbers paid, one row each."""
    wanted = checks.join(numbers.select("check_num"), "check_num", "left_semi")
    return voucher_checks.join(wanted, "check_id", "left_semi").select("check_id", "voucher_id")


def check_void_status(checks: DataFrame, transactions: DataFrame, close_date: dt.date) -> DataFrame:
    """Whether a check may be voided, and whether its posting lies in a closed period.

    A check with several transactions is judged by the first of them.
    """
    first = (
        check_transactions(transactions)
        .groupBy("check_id")
        .agg(F.min(F.struct("trans_id", "post_date")).alias("_t"))
    )
    status = (
        F.when(is_true("cleared"), "cleared").when(F.col("_t").isNull(), "not posted").otherwise("voidable")
    )
    return checks.join(first, "check_id", "left").select(
        *checks.columns,
        F.col("_t.trans_id").alias("trans_id"),
        status.alias("status"),
        F.when(F.col("_t").isNotNull(), F.coalesce(F.col("_t.post_date") <= F.lit(close_date), F.lit(False))).alias(
            "period_closed"
        ),
    )


def void_check_entries(voidable: DataFrame) -> DataFrame:
    """Reversal of voidable checks: the bank account against cost, both under the vendor."""
    amount, vendor = F.col("amount"), F.col("vendor_id")
    rows = emit(
        voidable.filter(F.col("status") == "voidable"),
        {
            "trans_ref": F.lit("check"),
            "trans_ref_id": "check_id",
            "description": F.lit(CHECK_VOIDED),
        },
        debit("vendor", vendor, F.col("account"), amount),
        credit("vendor", vendor, COST, amount),
    )
    return rows.withColumn("memo", F.when(F.col("account") == COST, F.lit(VOID_MEMO)))


def void_check_log(voidable: DataFrame) -> DataFrame:
    """The log row of every check that is voided."""
    return voidable.filter(F.col("status") == "voidable").select(
        F.lit("check").alias("ref"), F.col("check_id").alias("ref_id"), F.lit(CHECK_LOG).alias("message")
    )


def checks_to_cancel(checks: DataFrame, transactions: DataFrame, numbers: DataFrame) -> DataFrame:
    """Checks by number, of consignors and of others, with each ledger transaction of theirs (none: a NULL one)."""
    wanted = checks.join(numbers.select("check_num"), "check_num", "left_semi")
    return wanted.join(check_transactions(transactions).drop("post_date"), "check_id", "left").select(
        "check_id", "check_num", "check_date", "vendor_id", "amount", "trans_id"
    )


def void_check_state(voidable: DataFrame, at: Column) -> DataFrame:
    """Checks after voiding: closed, stripped of their number, which is kept aside."""
    void = F.col("status") == "voidable"
    return voidable.select(
        "check_id", "vendor_id", "amount",
        F.when(void, F.lit(True)).otherwise(F.col("closed")).alias("closed"),
        F.when(~void, F.col("cleared")).alias("cleared"),
        F.when(void, at).otherwise(F.col("void_ts")).alias("void_ts"),
        F.when(void, F.col("check_num")).otherwise(F.col("void_check_num")).alias("void_check_num"),
        F.when(~void, F.col("check_num")).alias("check_num"),
    )


class StoreCreditFromChecks(NamedTuple):
    """What turning checks into store credit leaves behind."""

    entries: DataFrame
    vouchers: DataFrame
    voucher_items: DataFrame
    consignors: DataFrame
    owners: DataFrame


def check_to_store_credit(
    voidable: DataFrame,
    consignors: DataFrame,
    customers: DataFrame,
    vouchers: DataFrame,
    voucher_items: DataFrame,
    voucher_checks: DataFrame,
) -> StoreCreditFromChecks:
    """Void checks and give their amount to the consignor as store credit.

    The vouchers a check paid are removed with their lines; a consignor without a customer gets one.
    ``owners`` (check_id, customer_id) tells who got the credit of which check.
    """
    usable = voidable.filter(F.col("status") == "voidable")
    owners = backfill_customers(consignors, customers, usable.select("vendor_id").distinct())
    party = owners.filter(F.col("vendor_id").isNotNull()).select("ct_consign_id", "vendor_id", "customer_id")
    entries = emit(
        usable.select("check_id", "vendor_id", "amount").join(party, "vendor_id"),
        {
            "check_id": "check_id",
            "trans_ref": F.lit("ct_consign"),
            "trans_ref_id": "ct_consign_id",
            "description": F.lit(CHECK_CONVERTED),
        },
        debit("vendor", F.col("vendor_id"), CONSIGNOR, F.col("amount")),
        credit("customer", F.col("customer_id"), CONSIGNOR, F.col("amount")),
    )
    known = usable.join(party.select("vendor_id"), "vendor_id", "left_semi")
    gone = voucher_checks.join(known.select("check_id"), "check_id", "left_semi").select("voucher_id")
    return StoreCreditFromChecks(
        entries,
        vouchers.join(gone, "voucher_id", "left_anti"),
        voucher_items.join(gone, "voucher_id", "left_anti"),
        owners,
        usable.join(party, "vendor_id").select("check_id", "customer_id"),
    )


def orders_after_check(orders: DataFrame, walk_in: DataFrame, moves: DataFrame) -> DataFrame:
    """Orders of the walk-in customer move to the customer whose check was cashed on them.

    ``moves`` (order_id, new_customer_id); of several moves of an order the one to the smallest customer id counts.
    """
    moves = moves.groupBy("order_id").agg(F.min("new_customer_id").alias("new_customer_id"))
    anonymous = walk_in.select("customer_id", F.lit(True).alias("_walk_in"))
    return (
        orders.join(moves, "order_id", "left")
        .join(anonymous, "customer_id", "left")
        .select(
            "order_id",
            F.when(is_true("_walk_in"), F.coalesce("new_customer_id", "customer_id"))
            .otherwise(F.col("customer_id")).alias("customer_id"),
        )
    )


