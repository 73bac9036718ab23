"""Many requests against balances that run out: store credit in turn, and gift cards that pay once.

``payments`` answers one request by what its account holds now. Here the requests of a run follow each other, so
that no balance is spent twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.allocation import first_claims, in_turn
from ..functions.money import is_true, money, or_zero, zero
from .balances import balances_by_consignor, paid_per_order
from .payments import cash_gift_to_account

# Why a gift is refused.
NO_ACCOUNT = "choose a customer account to apply the balance"
NO_CARD = "not a valid gift card number"
SPENT = "gift card does not have a balance left"
FILLED = "order has lines"


def bearable(balance: Column, asked: Column) -> Column:
    """What an account bears of a request: refunds whole, nothing below zero, else up to the balance."""
    return F.when(asked < 0, asked).when(balance < 0, zero()).otherwise(F.least(balance, asked))


def credit_amount(found: Column, row: Column) -> Column:
    """What a request takes from the account's balance: its order's earlier credit is not there for it, and an amount
    that was named for the case of a shortage counts in that case, from a cash account as far as it is borne."""
    balance, asked, named = found - row["taken"], row["requested"], row["use_amount"]
    bears = bearable(balance, asked)
    return F.when((bears >= asked) | named.isNull(), bears).when(row["cash"], F.least(named, bears)).otherwise(named)


def spend_store_credit(
    requests: DataFrame, orders: DataFrame, consignors: DataFrame, postings: DataFrame, payments: DataFrame, methods: DataFrame
) -> DataFrame:
    """Store credit that each request takes, request after request of an account.

    ``requests`` (order_id, requested, and if there are such columns request_id, use_amount and ct_consign_id). Without
    ct_consign_id the account is that of the order's customer. Requests of an account follow each other by request id
    where there is one, then by order and amount. ``balance`` is what the request finds, less the credit its
    order has taken before. A short request takes what is left, or ``use_amount``, with which a
    credit account may be overdrawn, a cash account not. Requests without an account are left out; a missing amount is zero.
    """
    have = requests.columns
    asked = requests.select(
        (F.col("request_id") if "request_id" in have else F.lit(0)).cast("bigint").alias("request_id"),
        "order_id", or_zero("requested").alias("requested"),
        (money("use_amount") if "use_amount" in have else F.lit(None).cast("decimal(20,2)")).alias("use_amount"),
        *(["ct_consign_id"] if "ct_consign_id" in have else []),
    )
    held = balances_by_consignor(consignors.select("ct_consign_id", "customer_id", "vendor_id", "cash"), postings, posted_only=False)
    opening = held.select(
        "ct_consign_id", "customer_id", is_true("cash").alias("cash"), money(or_zero("cash_balance") + or_zero("credit_balance")).alias("opening")
    )
    if "ct_consign_id" in have:
        known = asked.join(opening.drop("customer_id"), "ct_consign_id")
    else:
        known = asked.join(orders.select("order_id", "customer_id"), "order_id").join(opening, "customer_id").drop("customer_id")
    before = paid_per_order(payments, methods).select("order_id", or_zero("store_credit_payments").alias("taken"))
    rows = known.join(before, "order_id", "left").withColumn("taken", or_zero("taken"))
    # Requests that are alike in all of this may stand in any order.
    rows = rows.withColumn("twin", F.monotonically_increasing_id())
    order_by = ["request_id", "order_id", "requested", "twin"]
    drawn = in_turn(rows, "ct_consign_id", order_by, "opening", credit_amount, "requested", ("found", "amount"))
    balance = money(F.col("found") - F.col("taken"))
    short = bearable(balance, F.col("requested")) < F.col("requested")
    return drawn.select(
        "request_id", "order_id", "ct_consign_id", "cash", "requested", balance.alias("balance"), "amount",
        money(F.col("found") - F.col("amount")).alias("left_balance"),
        short.alias("insufficient"), (short & ~F.col("cash")).alias("may_overdraw"),
    )


class CashedGifts(NamedTuple):
    """Gift lines with the payments that settle them, and the requests that were refused."""

    gifts: DataFrame
    rejected: DataFrame


def cash_gifts(
    requests: DataFrame, orders: DataFrame, lines: DataFrame, consignors: DataFrame, cards: DataFrame, gift_method: int
) -> CashedGifts:
    """Move what is left on cards to accounts; a card pays once and an order takes one card.

    ``requests`` (order_id, ct_consign_id, gift_card_id), in order of the order, the card and the account; ``cards`` from
    ``gift_card_balance``. ``rejected`` (order_id, ct_consign_id, gift_card_id, reason) has each request that got nothing;
    equal requests count once.
    """
    yes = F.lit(True)
    filled = lines.select("order_id").distinct().withColumn("_filled", yes)
    owners = consignors.select("ct_consign_id", yes.alias("_owner"))
    known = cards.select("gift_card_id", F.coalesce("available", F.lit(False)).alias("_available"))
    judged = (
        requests.select("order_id", "ct_consign_id", "gift_card_id").distinct()
        .join(orders.select("order_id"), "order_id", "left_semi")
        .join(filled, "order_id", "left").join(owners, "ct_consign_id", "left").join(known, "gift_card_id", "left")
        .withColumn(
            "reason",
            F.when(is_true("_filled"), FILLED).when(~is_true("_owner"), NO_ACCOUNT)
            .when(F.col("_available").isNull(), NO_CARD).when(~F.col("_available"), SPENT),
        )
        .select("order_id", "ct_consign_id", "gift_card_id", "reason")
    )
    able = judged.filter(F.col("reason").isNull()).drop("reason")
    claimed = first_claims(able, ["gift_card_id", "order_id"], ["order_id", "gift_card_id", "ct_consign_id"])
    granted = claimed.filter("granted").drop("granted")
    spent = granted.select("gift_card_id", yes.alias("_spent"))
    late = claimed.filter("not granted").join(spent, "gift_card_id", "left")
    late = late.select("order_id", "ct_consign_id", "gift_card_id", F.when(is_true("_spent"), SPENT).otherwise(FILLED).alias("reason"))
    refused = judged.filter(F.col("reason").isNotNull()).unionByName(late)
    return CashedGifts(cash_gift_to_account(granted, orders, lines, consignors, cards, gift_method), refused)
