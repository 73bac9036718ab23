"""Account balances drawn from the ledger.

Postings carry the post date of their transaction (``with_post_date`` adds it where it is stored
apart), so a balance is one map-side combined sum per account and party, with no join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import is_true, money, or_zero, total, zero
from .entries import CONSIGNOR, GIFT, PAYABLE


def with_post_date(postings: DataFrame, transactions: DataFrame) -> DataFrame:
    return postings.join(transactions.select("trans_id", "post_date"), "trans_id")


def party_balances(
    postings: DataFrame, ref: str, account: str, key: str, posted_only: bool = True, before=None
) -> DataFrame:
    """Σ(credit − debit) per party of one kind on one account, over posted, all, or earlier postings."""
    wanted = (F.col("ref") == ref) & (F.col("account") == account)
    if before is not None:
        wanted = wanted & (F.col("post_date") < F.lit(before).cast("date"))
    elif posted_only:
        wanted = wanted & F.col("post_date").isNotNull()
    return (
        postings.filter(wanted)
        .groupBy(F.col("ref_id").alias(key))
        .agg(total(F.col("credit") - F.col("debit")).alias("balance"))
    )


def vendor_cash_balance(postings: DataFrame, posted_only: bool = True) -> DataFrame:
    return party_balances(postings, "vendor", CONSIGNOR, "vendor_id", posted_only)


def customer_credit_balance(postings: DataFrame, posted_only: bool = True) -> DataFrame:
    return party_balances(postings, "customer", CONSIGNOR, "customer_id", posted_only)


def balance_all_postings(postings: DataFrame) -> DataFrame:
    """Vendor and customer balances counting unposted transactions too."""
    return (
        postings.filter((F.col("account") == CONSIGNOR) & F.col("ref").isin("vendor", "customer"))
        .groupBy("ref", "ref_id")
        .agg(total(F.col("credit") - F.col("debit")).alias("balance"))
    )


def balances_by_consignor(consignors: DataFrame, postings: DataFrame, posted_only: bool = True) -> DataFrame:
    """Consignors with their cash and credit balance, NULL where there are no postings.

    The ledger is summed once for both sides; each consignor then looks up its two parties.
    """
    wanted = (F.col("account") == CONSIGNOR) & F.col("ref").isin("vendor", "customer")
    if posted_only:
        wanted = wanted & F.col("post_date").isNotNull()
    sums = (
        postings.filter(wanted)
        .groupBy("ref", "ref_id")
        .agg(total(F.col("credit") - F.col("debit")).alias("_balance"))
    )
    sides = F.array(
        F.struct(F.lit("vendor").alias("ref"), F.col("vendor_id").alias("ref_id")),
        F.struct(F.lit("customer").alias("ref"), F.col("customer_id").alias("ref_id")),
    )
    own = consignors.columns
    return (
        consignors.select(*own, F.inline(sides))
        .join(sums, ["ref", "ref_id"], "left")
        .groupBy(*own)
        .agg(
            F.max(F.when(F.col("ref") == "vendor", F.col("_balance"))).alias("cash_balance"),
            F.max(F.when(F.col("ref") == "customer", F.col("_balance"))).alias("credit_balance"),
        )
    )


def account_list(consignors: DataFrame, postings: DataFrame, show_all: bool = True) -> DataFrame:
    """All (or only active) accounts with both balances and their sum, by name."""
    kept = consignors if show_all else consignors.filter(F.col("inactive_ts").isNull())
    return (
        balances_by_consignor(kept, postings)
        .select(
            "ct_consign_id", "name", "cash", "vendor_id", "customer_id", "cash_balance", "credit_balance",
            money(or_zero("cash_balance") + or_zero("credit_balance")).alias("total_balance"),
        )
        .orderBy("name")
    )


def account_statement_total(consignors: DataFrame, postings: DataFrame) -> DataFrame:
    """Statement figures: a balance only for a side the account has, a total only with both sides."""
    vendor, customer = F.col("vendor_id").isNotNull(), F.col("customer_id").isNotNull()
    cash, owed = or_zero("cash_balance"), or_zero("credit_balance")
    return balances_by_consignor(consignors, postings).select(
        "ct_consign_id",
        F.when(vendor, cash).alias("cash_balance"),
        F.when(customer, owed).alias("credit_balance"),
        F.when(vendor & customer, money(cash + owed)).alias("total_balance"),
    )


def gift_card_balance(cards: DataFrame, postings: DataFrame, amount: Decimal | str) -> DataFrame:
    """Posted balance per card, whether it falls short of ``amount``, and whether anything is left."""
    held = party_balances(postings, "gift_card", GIFT, "gift_card_id")
    asked = F.lit(str(amount)).cast("decimal(20,2)")
    known = cards.select("gift_card_id", "legacy_code", "name", "amount")
    return known.join(held, "gift_card_id", "left").select(
        *known.columns, "balance",
        (asked > or_zero("balance")).alias("no_balance"),
        (or_zero("balance") > 0).alias("available"),
    )


def gift_card_lookup(codes: DataFrame, cards: DataFrame) -> DataFrame:
    """Card of each entered code: an all-digit code is tried as the id first, then as the old code."""
    number = F.when(F.col("code").rlike("^[0-9]+$"), F.expr("try_cast(code AS bigint)"))
    by_id = cards.select(F.col("gift_card_id").alias("_id"))
    by_code = cards.groupBy(F.col("legacy_code").alias("code")).agg(F.min("gift_card_id").alias("_old"))
    return (
        codes.withColumn("_number", number)
        .join(by_id, F.col("_number") == F.col("_id"), "left")
        .join(by_code, "code", "left")
        .select(*codes.columns, F.coalesce("_id", "_old").alias("gift_card_id"))
    )


def ap_balance(postings: DataFrame, vendors: DataFrame) -> DataFrame:
    """Open payables per known vendor."""
    open_ap = party_balances(postings, "vendor", PAYABLE, "vendor_id").filter(F.col("balance") != 0)
    return open_ap.join(vendors.select("vendor_id"), "vendor_id", "left_semi")


def paid_per_order(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """Payments taken per order, and the store credit among them."""
    kinds = methods.select("payment_method_id", "store_credit")
    by_credit = F.when(is_true("store_credit"), F.col("amount"))
    return (
        payments.join(kinds, "payment_method_id")
        .groupBy("order_id")
        .agg(total("amount").alias("paid"), total(by_credit).alias("store_credit_payments"))
    )


def store_credit_available(
    orders: DataFrame, consignors: DataFrame, postings: DataFrame, payments: DataFrame, methods: DataFrame
) -> DataFrame:
    """Per order of a consignor: both balances, posted or not, less store credit on that order."""
    held = balances_by_consignor(consignors, postings, posted_only=False)
    taken = paid_per_order(payments, methods).select("order_id", "store_credit_payments")
    return (
        orders.select("order_id", "customer_id")
        .join(held, "customer_id")
        .join(taken, "order_id", "left")
        .select(
            "order_id", "ct_consign_id", "customer_id", "vendor_id", "cash",
            money(
                or_zero("cash_balance") + or_zero("credit_balance") - or_zero("store_credit_payments")
            ).alias("balance"),
        )
    )


def customer_positions(consignors: DataFrame, postings: DataFrame) -> DataFrame:
    """Per customer: own balance plus that of the vendor account the same consignor holds."""
    linked = consignors.filter(F.col("customer_id").isNotNull() & F.col("vendor_id").isNotNull()).select(
        F.lit("vendor").alias("ref"), F.col("vendor_id").alias("ref_id"), F.col("customer_id").alias("_linked")
    )
    customer = F.when(F.col("ref") == "customer", F.col("ref_id")).otherwise(F.col("_linked"))
    return (
        balance_all_postings(postings)
        .join(linked, ["ref", "ref_id"], "left")
        .groupBy(customer.alias("customer_id"))
        .agg(total("balance").alias("gl_credit_balance"))
        .filter(F.col("customer_id").isNotNull())
    )


def order_credit_position(
    balances_due: DataFrame,
    consignors: DataFrame,
    postings: DataFrame,
    equal_applies: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per order: what is due, the customer's ledger credit, and how much of it would be applied.

    ``balances_due`` comes from ``order_balance_due``; ``keep`` names further columns of it to carry
    along. Credit exactly equal to the amount due applies nothing, as in the original rule;
    ``equal_applies=True`` applies it in full.
    """
    due, free = F.col("order_balance"), F.col("gl_credit_balance") - F.col("store_credit_payments")
    covers = free >= due if equal_applies else free > due
    position = (
        balances_due.select(
            "order_id", "customer_id", F.col("balance_due").alias("order_balance"),
            or_zero("store_credit_payments").alias("store_credit_payments"), *keep,
        )
        .join(customer_positions(consignors, postings), "customer_id", "left")
        .withColumn("gl_credit_balance", or_zero("gl_credit_balance"))
    )
    return position.select(
        "order_id", "customer_id", "order_balance", "gl_credit_balance", "store_credit_payments",
        money(F.when((due > 0) & covers, due).when((due > 0) & (free < due), free).otherwise(zero())).alias(
            "apply_credit_balance"
        ),
        money(F.when(F.col("store_credit_payments") > 0, free)).alias("remaining_balance"),
        *keep,
    )


def consignor_item_revenue(consignors: DataFrame, postings: DataFrame) -> DataFrame:
    """Sales credited to each consignor's item."""
    sold = (
        postings.filter(F.col("ref") == "item")
        .groupBy(F.col("ref_id").alias("item_id"))
        .agg(total("credit").alias("revenue"))
    )
    return consignors.select("ct_consign_id", "name", "item_id").join(sold, "item_id")
