"""Payments on orders: change, store credit, merging, processing, tills and gift cards."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import next_ids, running_totals
from ..functions.money import is_true, money, or_zero, total, zero
from .balances import balances_by_consignor, paid_per_order
from .entries import (
    ACCOUNT_LINE, CONSIGNOR, GIFT_LINE, NO_CONSIGNOR, NO_CREDIT, UNNAMED_CARD,
)


def cash_change(tenders: DataFrame, balances_due: DataFrame) -> DataFrame:
    """Change for cash handed over: a tender above the amount due is kept only up to it."""
    change = money(F.col("tendered") - F.col("balance_due"))
    over = change > 0
    return tenders.join(balances_due.select("order_id", "balance_due"), "order_id").select(
        "order_id",
        money(F.when(over, F.col("tendered") - change).otherwise(F.col("tendered"))).alias("amount"),
        F.when(over, change).alias("cash_change"),
    )


def split_store_credit(requests: DataFrame, available: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """How much of a requested store-credit payment the account can bear.

    ``requests`` (order_id, requested) meets ``store_credit_available``. Negative requests pass
    unchanged; cash accounts may never overdraw, credit accounts may on request. ``keep`` names further columns
    of ``available`` to carry along.
    """
    held, asked = F.col("balance"), F.col("requested")
    bearable = money(F.when(held < 0, zero()).when(held >= asked, asked).when(held < asked, held))
    short = (asked >= 0) & (bearable < asked)
    return requests.join(available, "order_id").select(
        "order_id", "ct_consign_id", "cash", "requested", "balance",
        F.when(asked < 0, asked).otherwise(bearable).alias("amount"),
        money(held - asked).alias("end_balance"),
        short.alias("insufficient"),
        (short & ~is_true("cash")).alias("may_overdraw"),
        *keep,
    )


class NamedCredit(NamedTuple):
    """Store credit asked for by the consignor's id: payments, customers made, orders moved, requests refused."""

    payments: DataFrame
    customers: DataFrame
    moves: DataFrame
    rejected: DataFrame


def named_store_credit(
    requests: DataFrame, orders: DataFrame, consignors: DataFrame, customers: DataFrame, walk_in: DataFrame,
    postings: DataFrame, payments: DataFrame, methods: DataFrame,
) -> NamedCredit:
    """Pay orders from the credit of a consignor who is named at the till.

    ``requests`` (request_id, order_id, ct_consign_id, requested, use_amount); of several for an order the one with
    the highest request id counts. Only an order of the walk-in customer takes the named consignor, others use the
    one behind their own customer. A consignor with only a vendor gets a customer. The order moves to that customer
    unless the credit falls short; ``use_amount``, where given, is then paid instead (from a cash account
    no more than it holds).
    """
    last = requests.groupBy("order_id").agg(F.max(F.struct("request_id", "ct_consign_id", "requested", "use_amount")).alias("_r"))
    behind = consignors.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.min("ct_consign_id").alias("_own"))
    anonymous = walk_in.select("customer_id").distinct().withColumn("_walk_in", F.lit(True))
    named = (
        orders.select("order_id", "customer_id")
        .join(last, "order_id")
        .join(anonymous, "customer_id", "left")
        .join(behind, "customer_id", "left")
        .select(
            "order_id", "_r.requested", "_r.use_amount",
            F.when(is_true("_walk_in"), F.col("_r.ct_consign_id")).otherwise(F.col("_own")).alias("ct_consign_id"),
        )
    )
    held = balances_by_consignor(consignors.select("ct_consign_id", "vendor_id", "customer_id"), postings, posted_only=False).select(
        "ct_consign_id", money(or_zero("cash_balance") + or_zero("credit_balance")).alias("_held")
    )
    # Who is asked needs no ledger; only the balances do.
    found = named.join(consignors.select("ct_consign_id", "vendor_id", "customer_id", "cash"), "ct_consign_id", "left")
    no_party = F.col("vendor_id").isNull() & F.col("customer_id").isNull()
    reason = F.when(F.col("ct_consign_id").isNull(), NO_CONSIGNOR).when(no_party, NO_CREDIT)
    accepted = found.filter(reason.isNull())
    lacking = accepted.filter(F.col("customer_id").isNull()).select("ct_consign_id").distinct()
    made = next_ids(customers, "customer_id", lacking, ["ct_consign_id"], "_made")
    taken = paid_per_order(payments, methods).select("order_id", "store_credit_payments")
    available = (
        accepted.join(held, "ct_consign_id")
        .join(made, "ct_consign_id", "left")
        .join(taken, "order_id", "left")
        .select(
            "order_id", "ct_consign_id", "cash", "use_amount", F.coalesce("customer_id", "_made").alias("customer_id"),
            money(F.col("_held") - or_zero("store_credit_payments")).alias("balance"),
        )
    )
    split = split_store_credit(accepted.select("order_id", "requested"), available, keep=("customer_id", "use_amount"))
    chosen = F.when(is_true("cash"), F.least("use_amount", "amount")).otherwise(F.col("use_amount"))
    paid = split.withColumn("amount", money(F.when(F.col("insufficient") & chosen.isNotNull(), chosen).otherwise(F.col("amount"))))
    moves = paid.filter(~F.col("insufficient") | F.col("use_amount").isNotNull())
    return NamedCredit(
        paid.drop("use_amount"),
        made.select(F.col("_made").alias("customer_id"), "ct_consign_id"),
        moves.select("order_id", F.col("customer_id").alias("new_customer_id")),
        found.select("order_id", "ct_consign_id", reason.alias("reason")).filter(F.col("reason").isNotNull()),
    )


def accumulate_store_credit(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """One store-credit payment per order and method, amounts added; other payments stay as they are."""
    kinds = methods.select("payment_method_id", "store_credit")
    single = F.when(is_true("store_credit"), F.lit(None)).otherwise(F.col("order_payment_id"))
    return (
        payments.join(kinds, "payment_method_id")
        .groupBy("order_id", "payment_method_id", single.cast("bigint").alias("_single"))
        .agg(F.min("order_payment_id").alias("order_payment_id"), total("amount").alias("amount"))
        .drop("_single")
    )


def _mergeable(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """Payments not yet processed whose method is not rung up at the till."""
    off_till = methods.filter(F.col("till_method").isNull()).select("payment_method_id")
    return payments.filter(F.col("customer_payment_id").isNull()).join(off_till, "payment_method_id", "left_semi")


def merge_duplicate_payments(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """Groups of unprocessed payments of one order and method that become one payment.

    The merged payment keeps neither gift card nor change; ``merged_payment_ids`` has the ids it replaces.
    """
    return (
        _mergeable(payments, methods)
        .groupBy("order_id", "payment_method_id")
        .agg(total("amount").alias("amount"), F.count("order_payment_id").alias("idcount"))
        .filter(F.col("idcount") > 1)
    )


def merged_payment_ids(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """The payments that merged ones replace, one row each."""
    keys = ["order_id", "payment_method_id"]
    groups = merge_duplicate_payments(payments, methods)
    return _mergeable(payments, methods).join(groups, keys, "left_semi").select(*keys, "order_payment_id")


def payments_after_merge(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """All payments once duplicates are merged; a merged payment takes the lowest id of its group."""
    kinds = methods.select("payment_method_id", "till_method")
    loose = F.col("customer_payment_id").isNull() & F.col("till_method").isNull()
    alone = F.when(~loose, F.col("order_payment_id"))
    return (
        payments.join(kinds, "payment_method_id")
        .groupBy("order_id", "payment_method_id", alone.alias("_alone"))
        .agg(
            F.min("order_payment_id").alias("order_payment_id"),
            total("amount").alias("amount"),
            F.min("gift_card_id").alias("gift_card_id"),
            F.min("customer_payment_id").alias("customer_payment_id"),
            F.count("order_payment_id").alias("_n"),
        )
        .select(
            "order_payment_id", "order_id", "payment_method_id", "amount", "customer_payment_id",
            F.when(F.col("_n") == 1, F.col("gift_card_id")).alias("gift_card_id"),
        )
    )


def payments_to_process(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """Unprocessed payments with what they need: gift card, processor, cash drawer, till."""
    needs = methods.select("payment_method_id", "payment_processor_id", "cash", "till_method")
    return payments.filter(F.col("customer_payment_id").isNull()).join(needs, "payment_method_id").select(
        "order_payment_id", "order_id", "payment_method_id", "amount", "gift_card_id", "payment_processor_id", "cash",
        "till_method",
    )


def customer_payments(pending: DataFrame, orders: DataFrame, taken: DataFrame, at: Column) -> DataFrame:
    """Processed payment rows for pending payments, numbered after the ids already ``taken``."""
    owners = orders.select("order_id", "customer_id", "location_id")
    ready = pending.join(owners, "order_id")
    return next_ids(taken, "customer_payment_id", ready, ["order_payment_id"], "customer_payment_id").select(
        "customer_payment_id", "order_payment_id", "order_id", "customer_id", "location_id",
        "payment_method_id", "amount", "payment_processor_id", "gift_card_id", at.alias("process_ts"),
    )


def link_processed(payments: DataFrame, processed: DataFrame) -> DataFrame:
    """Order payments with the id of the processed payment made from each."""
    made = processed.select("order_payment_id", F.col("customer_payment_id").alias("_made"))
    return payments.join(made, "order_payment_id", "left").select(
        *[F.coalesce(c, "_made").alias(c) if c == "customer_payment_id" else F.col(c) for c in payments.columns]
    )


def invoice_payments(processed: DataFrame, invoices: DataFrame) -> DataFrame:
    """Allocation of processed payments to the invoice of their order."""
    return processed.join(invoices.select("order_id", "invoice_id"), "order_id").select(
        "invoice_id", "amount", F.lit("customer_payment").alias("ref"), F.col("customer_payment_id").alias("ref_id")
    )


def latest_till(tills: DataFrame, locations: DataFrame) -> DataFrame:
    """Last till row per location; a location without one must balance its till first."""
    newest = tills.groupBy("location_id").agg(
        F.max(F.struct("created_ts", "till_transaction_id", "cash_balance")).alias("_last")
    )
    return locations.select("location_id").join(newest, "location_id", "left").select(
        "location_id", "_last.created_ts", "_last.till_transaction_id", "_last.cash_balance",
        F.col("_last").isNull().alias("must_balance_first"),
    )


def till_running_balance(payments: DataFrame, methods: DataFrame, openings: DataFrame) -> DataFrame:
    """Till balance after each till payment; only cash changes it.

    Locations without an opening balance are left out: their till must be balanced first.
    """
    kinds = methods.filter(is_true("till_method")).select("payment_method_id", "cash")
    rung = payments.join(kinds, "payment_method_id").select(
        "location_id", "process_ts", "customer_payment_id", "payment_method_id",
        F.when(is_true("cash"), money("amount")).otherwise(zero()).alias("cash_amount"),
    )
    running = running_totals(
        rung, ["process_ts", "customer_payment_id"], {"_added": "cash_amount"}, group_by=["location_id"]
    )
    return running.join(openings.select("location_id", "opening_balance"), "location_id").select(
        "location_id", "process_ts", "customer_payment_id", "payment_method_id",
        money(F.col("opening_balance") + F.col("_added")).alias("cash_balance"),
    )


def reclass_payment_postings(postings: DataFrame, payments: DataFrame, consignors: DataFrame) -> DataFrame:
    """Payment postings with the store credit of cash consignors moved to their vendor account."""
    paid = payments.select(F.col("customer_payment_id").alias("trans_ref_id"), "customer_id")
    cash_accounts = consignors.filter(
        is_true("cash") & F.col("vendor_id").isNotNull() & F.col("customer_id").isNotNull()
    ).select("customer_id", F.col("vendor_id").alias("_vendor"))
    moved = (F.col("account") == CONSIGNOR) & F.col("_vendor").isNotNull()
    return (
        postings.filter(F.col("trans_ref") == "customer_payment")
        .join(paid, "trans_ref_id")
        .join(cash_accounts, "customer_id", "left")
        .select(
            F.col("trans_ref_id").alias("customer_payment_id"),
            F.when(moved, F.lit("vendor")).otherwise(F.col("ref")).alias("ref"),
            F.when(moved, F.col("_vendor")).otherwise(F.col("ref_id")).alias("ref_id"),
            "account", "debit", "credit",
        )
    )


def reclass_store_credit_postings(postings: DataFrame, payments: DataFrame, consignors: DataFrame) -> DataFrame:
    """Only the store-credit side of payments, after the move."""
    return reclass_payment_postings(postings.filter(F.col("account") == CONSIGNOR), payments, consignors)


def allowed_payment_methods(
    employee_groups: DataFrame, method_groups: DataFrame, methods: DataFrame, employee_id: int | None = None
) -> DataFrame:
    """Methods that share a group with the employee (or with each employee), by name."""
    if employee_id is not None:
        groups = employee_groups.filter(F.col("employee_id") == employee_id)
        usable = method_groups.join(groups, "group_id", "left_semi")
        return (
            methods.join(usable, "payment_method_id", "left_semi")
            .select(F.lit(employee_id).cast("bigint").alias("employee_id"), "payment_method_id", "name")
            .orderBy("name")
        )
    return (
        employee_groups.join(method_groups, "group_id")
        .select("employee_id", "payment_method_id")
        .distinct()
        .join(methods.select("payment_method_id", "name"), "payment_method_id")
        .select("employee_id", "payment_method_id", "name")
    )


def new_gift_cards(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """A numbered card per card request; a blank name becomes 'unknown'."""
    sold = requests.filter((F.col("kind") == "card") & (F.coalesce("amount", F.lit(0)) != 0))
    named = sold.withColumn("name", F.coalesce(F.nullif(F.nullif(F.col("name"), F.lit("")), F.lit("0")), F.lit(UNNAMED_CARD)))
    return next_ids(cards, "gift_card_id", named, ["request_id"], "gift_card_id").select(
        "request_id", "order_id", "gift_card_id", "name", "amount"
    )


def issue_gift_lines(requests: DataFrame, cards: DataFrame, orders: DataFrame, consignors: DataFrame) -> DataFrame:
    """Order lines for gift-card sales, gifts to an account and payments on account.

    A gift to an account needs a consignor behind the order's customer; without one no line is made.
    """
    def line(df, kind, text, item_id, card_id):
        return df.select(
            "request_id", "order_id", F.lit(kind).alias("item_type"), text.alias("description"),
            item_id.cast("bigint").alias("item_id"), F.lit(1).alias("qty"), money("amount").alias("unit_price"),
            card_id.cast("bigint").alias("gift_card_id"),
        )

    none, card = F.lit(None), F.col("gift_card_id")
    asked = requests.filter(F.coalesce("amount", F.lit(0)) != 0)
    items = consignors.filter(F.col("customer_id").isNotNull()).select("customer_id", "item_id")
    to_account = (
        asked.filter(F.col("kind") == "account")
        .join(orders.select("order_id", "customer_id"), "order_id")
        .join(items, "customer_id")
    )
    on_account = asked.filter(F.col("kind") == "payment")
    sold = new_gift_cards(requests, cards)
    return (
        line(sold, "gift_card", F.concat(F.lit(GIFT_LINE + " "), card.cast("string")), none, card)
        .unionByName(line(to_account, "gift_card", F.lit(GIFT_LINE), F.col("item_id"), none))
        .unionByName(line(on_account, "pay_account", F.lit(ACCOUNT_LINE), none, none))
    )


def cash_gift_to_account(
    requests: DataFrame, orders: DataFrame, lines: DataFrame, consignors: DataFrame, cards: DataFrame, gift_method: int
) -> DataFrame:
    """Move what is left on a card to a consignor's account, on orders that have no lines.

    ``requests`` (order_id, ct_consign_id, gift_card_id); ``cards`` from ``gift_card_balance``. Each
    row holds the gift line (item, amount) and the gift-card payment that settles it.
    """
    filled_orders = lines.select("order_id").distinct()
    empty = orders.select("order_id").join(filled_orders, "order_id", "left_anti")
    owners = consignors.select(
        "ct_consign_id", "customer_id",
        F.when(F.col("customer_id").isNotNull(), F.col("item_id")).alias("item_id"),
    )
    filled = cards.filter("available").select("gift_card_id", "balance")
    return (
        requests.join(empty, "order_id", "left_semi")
        .join(owners, "ct_consign_id")
        .join(filled, "gift_card_id")
        .select(
            "order_id", "customer_id", F.lit("gift_card").alias("item_type"), "item_id", F.lit(1).alias("qty"),
            F.col("balance").alias("unit_price"),
            F.lit(gift_method).cast("bigint").alias("payment_method_id"),
            F.col("balance").alias("payment_amount"), "gift_card_id",
        )
    )


def one_move(moves: DataFrame) -> DataFrame:
    return moves.groupBy("order_id").agg(F.min("new_customer_id").alias("new_customer_id"))


def reassign_customer(orders: DataFrame, moves: DataFrame) -> DataFrame:
    """Orders with the customer given in ``moves`` (order_id, new_customer_id).

    Of several moves of an order the one to the smallest customer id counts.
    """
    return orders.join(one_move(moves), "order_id", "left").select(
        "order_id", F.coalesce("new_customer_id", "customer_id").alias("customer_id")
    )


def payments_after_reassign(
    payments: DataFrame, orders: DataFrame, moves: DataFrame, walk_in: DataFrame, methods: DataFrame
) -> DataFrame:
    """Payments left after customers change: store credit of the old customer is dropped.

    An order that belonged to the walk-in customer keeps its payments.
    """
    changed = (
        orders.join(one_move(moves), "order_id")
        .filter(F.col("customer_id") != F.col("new_customer_id"))
        .join(walk_in.select("customer_id"), "customer_id", "left_anti")
        .select("order_id", F.lit(True).alias("_changed"))
    )
    kinds = methods.select("payment_method_id", "store_credit")
    return (
        payments.join(kinds, "payment_method_id", "left")
        .join(changed, "order_id", "left")
        .filter(~(is_true("store_credit") & is_true("_changed")))
        .select(*payments.columns)
    )
