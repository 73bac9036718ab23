"""Operator inputs that the shop's tables do not hold as such: requests, staging lists, edits.

All are expressions over whole tables, so they grow with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, PRICE, RATE, money
from ..operators import accounts, balances, sales
from ..session import scratch_folder
from ..sources.shop import Shop

C = F.col

ORDER_DAY = dt.date(1998, 10, 3)
PAYMENT_DAY = dt.date(2024, 1, 15)
PAYOUT_MINIMUM = "100.00"
PAY_DATE = dt.date(1999, 1, 1)
RUN_DATE = dt.date(1999, 1, 2)
CLOSE_DATE = dt.date(1998, 6, 30)
CARD_AMOUNT = "500.00"
NOW = "2002-01-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def scratch(shop: Shop) -> str:
    """A fresh folder for one run under the cluster's shared folder."""
    return scratch_folder(shop.spark)


def consignor_staging(shop: Shop) -> DataFrame:
    key = C("s_suppkey")
    return shop.table("supplier").select(
        key.alias("ct_id"),
        C("s_name").alias("name"),
        F.when(key % 21 == 0, None).when(key % 3 != 0, "CA").otherwise("CR").alias("ctype"),
        (F.lit("31.25").cast("decimal(6,2)") + F.lit("3.33").cast("decimal(6,2)") * (key % 5).cast("int"))
        .cast("decimal(6,2)").alias("cper"),
        C("s_acctbal").cast(MONEY).alias("balance"),
    )


def key_fixes(shop: Shop) -> DataFrame:
    """Names whose staged id was wrong, with the right one."""
    return consignor_staging(shop).filter(C("ct_id") % 10 == 1).select("name", (C("ct_id") + 500000).alias("new_id"))


def fanned_out(shop: Shop) -> accounts.Accounts:
    return accounts.fan_out_accounts(
        accounts.import_consignors(consignor_staging(shop)), shop.vendors, shop.customers
    )


def staged_sales(shop: Shop) -> DataFrame:
    """Sales by month; seventh lines stand for empty rows of the staging list."""
    return shop.table("lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("batch"),
        C("l_suppkey").alias("ct_consign_id"),
        F.when(C("l_linenumber") == 7, F.lit(0)).otherwise(C("l_extendedprice")).cast(PRICE).alias("amount"),
    )


def batch_orders(shop: Shop) -> DataFrame:
    """One import order per month of sales."""
    month = F.regexp_replace("batch", "-", "").cast("bigint")
    return (
        staged_sales(shop).select("batch").distinct().select(
            "batch", (month + 900000000).alias("order_id"), (month % 25).alias("location_id"),
            F.lit("pos").alias("order_type"), F.lit("import").alias("order_status"),
        )
    )


def batch_shipping(shop: Shop) -> DataFrame:
    return batch_orders(shop).select("order_id", (C("order_id") + 1).alias("ship_id"))


def region_orders(shop: Shop) -> DataFrame:
    """One order per region; all but the last are being imported."""
    key = C("r_regionkey").cast("bigint")
    return shop.table("region").select(
        (key + 800000000).alias("order_id"), (key + 3).alias("location_id"), F.lit("pos").alias("order_type"),
        F.when(key == 4, "closed").otherwise("import").alias("order_status"),
    )


def region_shipping(shop: Shop) -> DataFrame:
    return region_orders(shop).select("order_id", (C("order_id") + 50).alias("ship_id"))


def unbatched_sales(shop: Shop) -> DataFrame:
    """A month's sum per consignor, without a batch; each seventh sold nothing."""
    key = C("s_suppkey")
    return shop.table("supplier").select(
        key.alias("ct_consign_id"), F.when(key % 7 == 0, 0).otherwise(C("s_acctbal")).cast("decimal(10,2)").alias("amount")
    )


def orders_being_imported(shop: Shop) -> DataFrame:
    open_one = C("order_status") == "pos"
    return shop.orders.select(
        "order_id", "location_id",
        F.when(open_one, "pos").otherwise(C("order_type")).alias("order_type"),
        F.when(open_one, "import").otherwise(C("order_status")).alias("order_status"),
    )


def partly_billed_lines(shop: Shop) -> DataFrame:
    """Lines of which the seventh of an order already belong to an earlier invoice."""
    earlier = C("line_number") == 7
    return shop.lines.withColumns(
        {
            "invoice_id": F.when(earlier, F.lit(-1)).cast("bigint"),
            "account": F.when(earlier, F.lit("other")),
        }
    )


def balances_due(shop: Shop) -> DataFrame:
    paid = balances.paid_per_order(shop.order_payments, shop.methods)
    return sales.order_balance_due(shop.orders, sales.order_totals(shop.lines), paid)


def tenders(shop: Shop) -> DataFrame:
    """Cash handed over per open order: ten short, exact, or ten over."""
    due = balances_due(shop)
    return due.select("order_id", money(C("balance_due") + (C("order_id") % 3 - 1) * 10).alias("tendered"))


def credit_requests(shop: Shop) -> DataFrame:
    """Every open order asks to be paid from store credit; each ninth is a refund."""
    due = balances_due(shop).filter(C("order_status") == "pos")
    asked = F.when(C("order_id") % 9 == 0, -C("balance_due")).otherwise(C("balance_due"))
    return due.select("order_id", money(asked).alias("requested"))


def walk_ins(shop: Shop) -> DataFrame:
    """Every fourth customer stands for a till's walk-in customer, so that many orders have one."""
    return shop.customers.filter(C("customer_id") % 4 == 1).select("customer_id")


def named_credit_requests(shop: Shop) -> DataFrame:
    """Open orders asked to be paid by a consignor's id: known, unknown or none; some settle for less.

    Each fifth order is asked for twice; the later request counts.
    """
    key = C("order_id")
    named = F.when(key % 12 == 0, F.lit(None)).when(key % 12 == 11, F.lit(-1)).otherwise(key % 60 + 1).cast("bigint")
    later = credit_requests(shop).select(
        (key * 2).alias("request_id"), "order_id", named.alias("ct_consign_id"), "requested",
        F.when(key % 2 == 0, money(25)).alias("use_amount"),
    )
    earlier = later.filter(key % 5 == 0).withColumns({"request_id": C("request_id") - 1, "requested": money(1)})
    return later.unionByName(earlier)


def discount_requests(shop: Shop) -> DataFrame:
    """Open undiscounted orders get between 0 and 49 percent off."""
    return shop.orders.filter((C("order_status") == "pos") & C("discount").isNull()).select(
        "order_id", (C("order_id") % 50).cast("int").alias("percent")
    )


def entered_discounts(shop: Shop) -> DataFrame:
    """Discounts as typed in, for every order."""
    key = C("order_id")
    typed = F.when(key % 4 == 0, "15").when(key % 4 == 1, "100").when(key % 4 == 2, "abc")
    return shop.orders.select(key.alias("request_id"), "order_id", typed.alias("percent"))


def stock(shop: Shop) -> DataFrame:
    """Items with a list price; every nineteenth consignor has no item."""
    key = C("s_suppkey")
    return shop.table("supplier").filter(key % 19 != 0).select(
        key.alias("item_id"), F.when(key % 4 == 0, F.lit(0)).otherwise(C("s_acctbal")).cast(PRICE).alias("unit_price")
    )


def scanned_lines(shop: Shop) -> DataFrame:
    """Lines as scanned at the till: some without a price, some without a quantity."""
    number = C("l_linenumber")
    return shop.table("lineitem").select(
        C("l_orderkey").alias("order_id"), number.alias("line_number"), C("l_suppkey").alias("item_id"),
        F.when(number % 3 == 0, F.lit(0)).when(number % 3 == 1, C("l_extendedprice")).cast(PRICE).alias("unit_price"),
        F.when(number % 5 != 0, C("l_quantity").cast("int")).alias("qty"),
    )


def gift_requests(shop: Shop) -> DataFrame:
    """Gift-card sales, gifts to accounts and payments on account."""
    kind = C("event_type")
    name = F.when(C("event_id") % 7 == 0, "").when(C("event_id") % 7 == 1, None).otherwise(C("props"))
    return shop.table("events").filter(kind.isin("signup", "view", "purchase")).select(
        C("event_id").alias("request_id"),
        F.expr("event_id div 3").alias("order_id"),
        F.when(kind == "signup", "card").when(kind == "view", "account").otherwise("payment").alias("kind"),
        name.alias("name"),
        C("value").cast(MONEY).alias("amount"),
    )


def card_cash_requests(shop: Shop) -> DataFrame:
    """Every open order asks to move a card to an account; only orders without lines may."""
    key = C("order_id")
    return shop.orders.filter(C("order_status") == "pos").select(
        "order_id", (key % 10).alias("ct_consign_id"), (key % 50 * 20).alias("gift_card_id")
    )


def entered_codes(shop: Shop) -> DataFrame:
    """Card numbers as typed: ids, old codes and unknown text."""
    key = C("event_id")
    number = (key % 150 * 20).cast("string")
    typed = (
        F.when(key % 4 == 0, number).when(key % 4 == 1, F.lpad(number, 6, "0"))
        .when(key % 4 == 2, F.concat(F.lit("X"), number)).otherwise(F.concat(F.lit("9999999999999999999"), number))
    )
    return shop.table("events").select(key.alias("request_id"), typed.alias("code"))


def customer_moves(shop: Shop) -> DataFrame:
    """A new customer for every third open order."""
    key = C("order_id")
    return shop.orders.filter(C("order_status") == "pos").select(
        "order_id", F.when(key % 3 == 0, C("customer_id") + 1).otherwise(C("customer_id")).alias("new_customer_id")
    )


def till_orders(shop: Shop) -> DataFrame:
    return shop.orders.filter(C("order_status") == "pos").select("order_id")


def doomed_lines(shop: Shop) -> DataFrame:
    """First lines of open orders."""
    return till_orders(shop).select("order_id", F.lit(1).alias("line_number"))


def doomed_payments(shop: Shop) -> DataFrame:
    """All card payments are asked to be removed; only unprocessed ones may go."""
    return shop.order_payments.filter(C("payment_method_id") == 2).select("order_id", "order_payment_id")


def adjustments(shop: Shop) -> DataFrame:
    kind = F.when(C("ct_id") % 2 == 0, "cash").otherwise("credit")
    return shop.opening_staging.select(C("ct_id").alias("ct_consign_id"), kind.alias("kind"), C("balance").alias("amount"))


def type_changes(shop: Shop) -> DataFrame:
    """Every account changes its type, with a higher, lower or unchanged rate."""
    key = C("ct_consign_id")
    full = accounts.backfill_vendors(accounts.backfill_customers(shop.consignors, shop.customers), shop.vendors)
    step = F.lit("0.0250").cast(RATE)
    rate = C("consign_percent")
    return full.select(
        "ct_consign_id", "vendor_id", "customer_id", (~C("cash")).alias("new_cash"), rate.alias("old_percent"),
        F.when(key % 3 == 0, rate + step).when(key % 3 == 1, rate - step).otherwise(rate).cast(RATE).alias("new_percent"),
    )


def account_edits(shop: Shop) -> DataFrame:
    """Every account's form as typed last, and for each fifth one an earlier try that the last replaces."""
    fields = ["ct_consign_id", "name", "cash", "consign_percent", "consign_fee"]
    last = shop.consignors_edited.select((C("ct_consign_id") * 2).alias("edit_id"), *fields)
    first = shop.consignors.filter(C("ct_consign_id") % 5 == 0).withColumns({"name": F.lit("Draft"), "cash": ~C("cash")})
    return last.unionByName(first.select((C("ct_consign_id") * 2 - 1).alias("edit_id"), *fields))


def check_numbers(shop: Shop) -> DataFrame:
    """Numbers asked for: every order's, whether or not a check carries it."""
    return shop.orders.select((C("order_id") + 5000).alias("check_num"))


def check_moves(owners: DataFrame) -> DataFrame:
    """Voided checks were cashed on the order of the same number, which goes to whom the credit went."""
    return owners.select(C("check_id").alias("order_id"), C("customer_id").alias("new_customer_id"))


def account_requests(shop: Shop) -> DataFrame:
    """Requests for new accounts, some incomplete, some with an id of their own, which may be taken."""
    key = C("c_custkey")
    return shop.table("customer").select(
        key.alias("request_id"),
        F.when(key % 33 == 0, key % 10).when(key % 22 == 0, F.expr("c_custkey div 44 * 44 + 2000000"))
        .when(key % 11 == 0, key + 2000000).alias("ct_consign_id"),
        F.when(key % 5 == 0, "").when(key % 5 == 1, C("c_name")).otherwise(
            F.concat(C("c_mktsegment"), F.lit(", "), C("c_name"))
        ).alias("name"),
        F.when(key % 7 != 0, key % 2 == 0).alias("cash"),
        F.when(key % 3 == 0, F.lit("0.0000")).otherwise(F.lit("0.4000")).cast(RATE).alias("consign_percent"),
        F.when(key % 4 == 0, F.lit("5.00")).when(key % 4 == 1, F.lit("0.00")).cast(PRICE).alias("consign_fee"),
    )
