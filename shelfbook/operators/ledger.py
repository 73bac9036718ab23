"""Posting invoices, payments and vouchers to the double-entry ledger, all documents at once."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, is_true, money, or_zero, total
from .entries import CASH, CONSIGNOR, COST, GIFT, PAYABLE, RECEIVABLE, SALES, TAX, credit, debit, emit

BOOKED = {"invoice_id": "invoice_id", "ref_date": "ref_date"}


def invoice_headers(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    """One ledger transaction per invoice, dated by the day the invoice was made."""
    names = customers.select("customer_id", F.col("company").alias("description"))
    return invoices.join(names, "customer_id", "left").select(
        F.lit("invoice").alias("ref"),
        F.col("invoice_id").alias("ref_id"),
        F.to_date("created_ts").alias("ref_date"),
        "description",
    )


def bill_lines(lines: DataFrame, invoices: DataFrame, rebill: bool = False) -> DataFrame:
    """Put the order's invoice and the sales account on its unbilled lines (or on all, ``rebill``).

    Of several invoices of an order the last one counts.
    """
    made = invoices.groupBy("order_id").agg(F.max("invoice_id").alias("_made"))
    billed = F.col("_made").isNotNull() & (F.lit(rebill) | F.col("invoice_id").isNull())
    return lines.join(made, "order_id", "left").select(
        *[
            F.when(billed, F.col("_made")).otherwise(F.col(c)).alias(c) if c == "invoice_id"
            else F.when(billed, F.lit(SALES)).otherwise(F.col(c)).alias(c) if c == "account"
            else F.col(c)
            for c in lines.columns
        ]
    )


def with_invoice(lines: DataFrame, invoices: DataFrame, on: str = "invoice_id") -> DataFrame:
    """Billed lines with their invoice's customer and date, joined on the invoice or on its order.

    Grouping by ``on`` first lets later aggregations reuse this join's partitioning.
    """
    heads = invoices.select(
        *dict.fromkeys([on, "invoice_id"]),
        F.col("customer_id").alias("invoice_customer_id"),
        F.to_date("created_ts").alias("ref_date"),
    )
    own = [c for c in lines.columns if c != "invoice_id" or on == "invoice_id"]
    return lines.select(*own).join(heads, on)


def invoice_keys(on: str) -> list[str]:
    return list(dict.fromkeys([on, "invoice_id", "invoice_customer_id", "ref_date"]))


def payees(consignors: DataFrame) -> DataFrame:
    """Per consigned item: whom a sale is owed to, at which rate, and which customer the owner is."""
    cash = is_true("cash")
    return consignors.select(
        "item_id",
        F.col("customer_id").alias("owner_customer_id"),
        F.col("vendor_id").alias("owner_vendor_id"),
        cash.alias("payee_is_vendor"),
        F.when(cash, F.col("vendor_id")).otherwise(F.col("customer_id")).alias("payee_id"),
        "consign_percent",
        "consign_fee",
        F.lit(True).alias("consigned"),
    )


def _payee_ref() -> Column:
    return F.when(F.col("payee_is_vendor"), "vendor").otherwise("customer")


def _revenue_target() -> tuple[Column, Column, Column]:
    """Where a revenue group is credited: (ref, ref_id, account)."""
    loose, gift = F.col("item_id").isNull(), F.col("item_type") == "gift_card"
    unnumbered = F.col("gift_card_id").isNull()
    on_account = F.col("item_type") == "pay_account"
    ref = (
        F.when(loose & gift & unnumbered, "invoice")
        .when(loose & gift, "gift_card")
        .when(loose | gift, "customer")
        .otherwise("item")
    )
    ref_id = (
        F.when(loose & gift & unnumbered, F.col("invoice_id"))
        .when(loose & gift, F.col("gift_card_id"))
        .when(loose, F.col("invoice_customer_id"))
        .when(gift, F.col("owner_customer_id"))
        .otherwise(F.col("item_id"))
    )
    account = (
        F.when(loose & gift, GIFT).when(loose & on_account, CONSIGNOR).when(gift, CONSIGNOR)
        .otherwise(F.col("account"))
    )
    return ref, ref_id, account


def invoice_revenue(lines: DataFrame, invoices: DataFrame, consignors: DataFrame, on: str = "invoice_id") -> DataFrame:
    """Sales per invoice, account, item, line type and gift card, credited to the party it belongs to."""
    sums = (
        with_invoice(lines, invoices, on)
        .groupBy(*invoice_keys(on), "account", "item_id", "item_type", "gift_card_id")
        .agg(total("total_price").alias("amount"))
        .join(payees(consignors).select("item_id", "owner_customer_id"), "item_id", "left")
    )
    return emit(sums, BOOKED, credit(*_revenue_target(), F.col("amount")))


def invoice_tax(lines: DataFrame, invoices: DataFrame, on: str = "invoice_id") -> DataFrame:
    """Sales tax per invoice; nothing when it is zero or unknown."""
    sums = with_invoice(lines, invoices, on).groupBy(*invoice_keys(on)).agg(total("tax_amount").alias("tax"))
    return emit(sums.filter(F.col("tax") != 0), BOOKED, credit(None, None, TAX, F.col("tax")))


def invoice_receivable(lines: DataFrame, invoices: DataFrame, on: str = "invoice_id") -> DataFrame:
    """What the customer owes per invoice: lines plus tax."""
    sums = (
        with_invoice(lines, invoices, on)
        .groupBy(*invoice_keys(on))
        .agg(money(F.sum("total_price") + F.coalesce(F.sum("tax_amount"), F.lit(0))).alias("amount"))
    )
    return emit(sums, BOOKED, debit("customer", F.col("invoice_customer_id"), RECEIVABLE, F.col("amount")))


def _share(amount: Column, qty: Column) -> Column:
    """A payee's part of summed sales, rounded once after the sum."""
    flat = money(amount - qty * F.col("consign_fee"))
    return F.when(F.col("consign_fee").isNotNull(), flat).otherwise(money(amount * F.col("consign_percent")))


# What tells the shares of an invoice apart.
PAYEE = ("owner_vendor_id", "owner_customer_id", "payee_is_vendor", "payee_id", "consign_percent", "consign_fee")


def consignor_share(lines: DataFrame, invoices: DataFrame, consignors: DataFrame, on: str = "invoice_id") -> DataFrame:
    """What each consignor is owed per invoice; gift-card lines earn nothing.

    Accounts are told apart by both their ids, also where the one they are paid under is unknown.
    """
    sold = lines.filter(F.col("item_type") != "gift_card").join(payees(consignors), "item_id")
    return (
        with_invoice(sold, invoices, on)
        .groupBy(*invoice_keys(on), *PAYEE)
        .agg(F.sum("total_price").alias("amount"), F.sum("qty").alias("qty"))
        .select(
            "invoice_id", "ref_date", _payee_ref().alias("ref"), F.col("payee_id").alias("ref_id"),
            _share(F.col("amount"), F.col("qty")).alias("amount"),
        )
    )


def consignor_entries(shares: DataFrame) -> DataFrame:
    """Each share as a credit to the consignor and a matching cost."""
    party = (F.col("ref"), F.col("ref_id"))
    return emit(
        shares, BOOKED, credit(*party, CONSIGNOR, F.col("amount")), debit(*party, COST, F.col("amount"))
    )


# The sums an order line takes part in.
REVENUE, SHARE, WHOLE = 1, 2, 3


def _line_parts(accounts: Sequence[str] | None) -> Column:
    """A line as keys of the sums it takes part in; fields that do not matter to a sum are NULL.

    With ``accounts``, only sums that can give a posting of one of them.
    """
    def gives(*made: str) -> bool:
        return accounts is None or not set(made).isdisjoint(accounts)

    def part(kind: int, *keys: str) -> Column:
        fields = {
            "account": "string", "item_id": "bigint", "item_type": "string", "gift_card_id": "bigint",
            "owner_customer_id": "bigint", "owner_vendor_id": "bigint", "payee_is_vendor": "boolean", "payee_id": "bigint",
            "consign_percent": "decimal(5,4)", "consign_fee": "decimal(10,2)",
        }
        cells = [(F.col(f) if f in keys else F.lit(None)).cast(t).alias(f) for f, t in fields.items()]
        return F.struct(F.lit(kind).cast("tinyint").alias("kind"), *cells)

    revenue = part(REVENUE, "account", "item_id", "item_type", "gift_card_id", "owner_customer_id")
    share = part(SHARE, *PAYEE)
    earns = is_true("consigned") & (F.col("item_type") != "gift_card")
    parts = [revenue if accounts is None else F.when(_revenue_target()[2].isin(*accounts), revenue)]
    if gives(CONSIGNOR, COST):
        parts.append(F.when(earns, share))
    if gives(TAX, RECEIVABLE):
        parts.append(part(WHOLE))
    return F.array(*parts)


def post_invoices(
    lines: DataFrame, invoices: DataFrame, consignors: DataFrame, on: str = "invoice_id",
    accounts: Sequence[str] | None = None,
) -> DataFrame:
    """Every posting of every invoice in one pass.

    Each line is split into the sums it takes part in (revenue group, payee share, invoice total) and
    one aggregation serves all of them. Lines are joined to consignors first, so a consignor with a
    large part of all sales is split by AQE, and the aggregation reuses the invoice join's
    partitioning unless that join was itself split. ``accounts`` restricts the result to postings of these
    accounts; sums that give none of them are not made.
    """
    sold = with_invoice(lines.join(payees(consignors), "item_id", "left"), invoices, on)
    keys, measures = invoice_keys(on), ["total_price", "tax_amount", "qty"]
    parts = sold.select(*keys, *measures, F.explode(_line_parts(accounts)).alias("part")).filter(F.col("part").isNotNull())
    split = parts.select(*keys, *measures, "part.*")
    sums = split.groupBy(*[c for c in split.columns if c not in measures]).agg(
        F.sum("total_price").alias("amount"), F.sum("tax_amount").alias("tax"), F.sum("qty").alias("qty")
    )
    kind, customer = F.col("kind"), ("customer", F.col("invoice_customer_id"))
    payee, owed = (_payee_ref(), F.col("payee_id")), _share(F.col("amount"), F.col("qty"))
    whole = F.col("amount") + F.coalesce(F.col("tax"), F.lit(0).cast(MONEY))
    sides = {
        CONSIGNOR: F.when(kind == SHARE, credit(*payee, CONSIGNOR, owed)),
        COST: F.when(kind == SHARE, debit(*payee, COST, owed)),
        TAX: F.when((kind == WHOLE) & (F.col("tax") != 0), credit(None, None, TAX, F.col("tax"))),
        RECEIVABLE: F.when(kind == WHOLE, debit(*customer, RECEIVABLE, whole)),
    }
    made = [side for account, side in sides.items() if accounts is None or account in accounts]
    revenue = F.when(kind == REVENUE, credit(*_revenue_target(), F.col("amount")))
    return emit(sums, BOOKED, revenue, *made)


def ledger_balance_check(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Transactions whose debits and credits differ; empty on a sound ledger."""
    return (
        postings.groupBy(*keys)
        .agg(total("debit").alias("debit"), total("credit").alias("credit"))
        .filter(F.col("debit") != F.col("credit"))
    )


def post_all(transactions: DataFrame) -> DataFrame:
    """Post every open transaction on its reference date."""
    return transactions.withColumn("post_date", F.coalesce("post_date", "ref_date"))


class Posted(NamedTuple):
    """Transactions after a posting run, and those that were refused with both of their sums."""

    transactions: DataFrame
    refused: DataFrame


def _gate(transactions: DataFrame, postings: DataFrame) -> DataFrame:
    """Transactions with the sums of their postings; without postings both are zero."""
    sums = postings.groupBy("trans_id").agg(total("debit").alias("_debit"), total("credit").alias("_credit"))
    return transactions.join(sums, "trans_id", "left").withColumns({c: or_zero(c) for c in ("_debit", "_credit")})


def _through(gated: DataFrame, wanted: Column, dates: dict[str, Column], columns: list[str]) -> Posted:
    """Wanted transactions take their ``dates`` if they balance, else lose their post date and are listed."""
    fits = F.col("_debit") == F.col("_credit")
    dates = {c: F.when(wanted, d).otherwise(F.col(c)) for c, d in dates.items()}
    dates["post_date"] = F.when(wanted & ~fits, F.lit(None)).otherwise(dates["post_date"])
    refused = gated.filter(wanted & ~fits).select("trans_id", "ref", "ref_id", F.col("_debit").alias("debit"), F.col("_credit").alias("credit"))
    return Posted(gated.withColumns(dates).select(*columns), refused)


def post_balanced(transactions: DataFrame, postings: DataFrame) -> Posted:
    """Post every open transaction whose debits equal its credits, on its reference date; the others stay open."""
    gated = _gate(transactions, postings)
    return _through(gated, F.col("post_date").isNull(), {"post_date": F.col("ref_date")}, transactions.columns)


def repost_balanced(transactions: DataFrame, dates: DataFrame, postings: DataFrame) -> Posted:
    """Unpost the listed transactions, give them a new date and post those again that balance.

    ``dates`` holds (trans_id, new_date); the earliest date wins where a transaction is listed twice. One that does not
    balance gets the date and stays open. Only listed transactions are summed.
    """
    one = dates.groupBy("trans_id").agg(F.min("new_date").alias("_new")).filter(F.col("_new").isNotNull())
    gated = _gate(transactions.join(one, "trans_id", "left"), postings.join(one, "trans_id", "left_semi"))
    new = {"ref_date": F.col("_new"), "post_date": F.col("_new")}
    return _through(gated, F.col("_new").isNotNull(), new, transactions.columns)


def count_open(transactions: DataFrame) -> DataFrame:
    """How many transactions a posting run posts."""
    return transactions.agg(F.count_if(F.col("post_date").isNull()).alias("posted"))


def repost_with_new_date(transactions: DataFrame, dates: DataFrame) -> DataFrame:
    """Unpost the listed transactions, give them a new date and post them again.

    ``dates`` holds (trans_id, new_date); the earliest date wins where a transaction is listed twice.
    """
    one = dates.groupBy("trans_id").agg(F.min("new_date").alias("_new"))
    moved = transactions.join(one, "trans_id", "left")
    fresh = {c: F.coalesce(F.col("_new"), F.col(c)) for c in ("ref_date", "post_date")}
    return moved.withColumns(fresh).drop("_new")


def payment_entries(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """Postings of processed customer payments.

    The customer's receivable falls; the other side is the customer's own balance for store credit,
    the card for gift cards, and the cash account for everything else.
    """
    kinds = methods.select("payment_method_id", "store_credit", "gift_card")
    paid = payments.filter(F.col("process_ts").isNotNull()).join(kinds, "payment_method_id")
    amount, customer = F.col("amount"), F.col("customer_id")
    store, card = is_true("store_credit"), is_true("gift_card")
    keep = {
        "trans_ref": F.lit("customer_payment"),
        "trans_ref_id": "customer_payment_id",
        "ref_date": F.to_date("process_ts"),
    }
    return emit(
        paid,
        keep,
        credit("customer", customer, RECEIVABLE, amount),
        F.when(store, debit("customer", customer, CONSIGNOR, amount))
        .when(card, debit("gift_card", F.col("gift_card_id"), GIFT, amount))
        .otherwise(debit(None, None, CASH, amount)),
    )


def voucher_entries(voucher_lines: DataFrame) -> DataFrame:
    """Each voucher line debited to its account, each voucher credited once to the vendor's payables."""
    cost = money(F.col("qty") * F.col("unit_cost"))
    split = emit(
        voucher_lines.withColumn("cost", cost),
        {"vendor_id": "vendor_id", "ref_num": "ref_num", "line": "line_number"},
        debit(F.col("ref"), F.col("ref_id"), F.col("account"), F.col("cost")),
        credit("vendor", F.col("vendor_id"), PAYABLE, F.col("cost")),
    )
    # The payable side drops the line number, so one sum merges it per voucher and keeps lines apart.
    line = F.when(F.col("account") != PAYABLE, F.col("line"))
    return (
        split.withColumn("line", line)
        .groupBy("vendor_id", "ref_num", "line", "ref", "ref_id", "account")
        .agg(total("debit").alias("debit"), total("credit").alias("credit"))
        .drop("line")
    )
