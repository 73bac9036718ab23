"""Consignor accounts: creation, bulk import, validation and linked vendor and customer records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import next_ids
from ..functions.money import RATE, is_true
from ..functions.text import legal_name


class Accounts(NamedTuple):
    """A set of consignors with the item, vendor and customer records made for them."""

    consignors: DataFrame
    items: DataFrame
    vendors: DataFrame
    customers: DataFrame


def import_consignors(staging: DataFrame) -> DataFrame:
    """Staged accounts (ct_id, name, ctype, cper) as consignors; type 'CA' is a cash account."""
    return staging.select(
        F.col("ct_id").alias("ct_consign_id"),
        "name",
        is_true(F.col("ctype") == "CA").alias("cash"),
        (F.col("cper").cast("decimal(9,4)") * F.lit("0.01").cast("decimal(3,2)")).cast(RATE).alias("consign_percent"),
    )


def patch_keys(staging: DataFrame, fixes: DataFrame) -> DataFrame:
    """Correct staged ids by name; ``fixes`` (name, new_id)."""
    one = fixes.groupBy("name").agg(F.min("new_id").alias("_new"))
    return staging.join(one, "name", "left").select(
        *[F.coalesce("_new", "ct_id").alias("ct_id") if c == "ct_id" else F.col(c) for c in staging.columns]
    )


def fan_out_accounts(consignors: DataFrame, vendors: DataFrame, customers: DataFrame) -> Accounts:
    """Give each consignor its item, and a new vendor (cash) or customer (credit), linked back.

    New records carry the consignor id as text, and the link is made on that text.
    """
    key = F.col("ct_consign_id").cast("string")
    cash = consignors.filter("cash").select("name", key.alias("account"), "ct_consign_id")
    owed = consignors.filter(~is_true("cash")).select("name", key.alias("email_phone"), "ct_consign_id")
    new_vendors = next_ids(vendors, "vendor_id", cash, ["ct_consign_id"], "vendor_id").select(
        "vendor_id", "name", "account"
    )
    new_customers = next_ids(customers, "customer_id", owed, ["ct_consign_id"], "customer_id").select(
        "customer_id", F.col("name").alias("company"), "email_phone"
    )
    items = consignors.select(F.col("ct_consign_id").alias("item_id"), key.alias("name"))
    linked = (
        consignors.withColumn("_key", key)
        .join(new_vendors.select(F.col("account").alias("_key"), "vendor_id"), "_key", "left")
        .join(new_customers.select(F.col("email_phone").alias("_key"), "customer_id"), "_key", "left")
        .select(
            "ct_consign_id", "name", "cash", "consign_percent",
            F.col("ct_consign_id").alias("item_id"), "vendor_id", "customer_id",
        )
    )
    return Accounts(linked, items, new_vendors, new_customers)


def backfill_customers(consignors: DataFrame, customers: DataFrame, vendor_ids: DataFrame | None = None) -> DataFrame:
    """Give consignors that only have a vendor a new customer id; running it again changes nothing."""
    lacking = consignors.filter(F.col("vendor_id").isNotNull() & F.col("customer_id").isNull())
    if vendor_ids is not None:
        lacking = lacking.join(vendor_ids.select("vendor_id"), "vendor_id", "left_semi")
    made = next_ids(customers, "customer_id", lacking.select("ct_consign_id"), ["ct_consign_id"], "_made")
    return _fill(consignors, made, "customer_id")


def backfill_vendors(consignors: DataFrame, vendors: DataFrame) -> DataFrame:
    """The mirror case, for credit accounts that become cash accounts."""
    lacking = consignors.filter(F.col("customer_id").isNotNull() & F.col("vendor_id").isNull())
    made = next_ids(vendors, "vendor_id", lacking.select("ct_consign_id"), ["ct_consign_id"], "_made")
    return _fill(consignors, made, "vendor_id")


def _fill(consignors: DataFrame, made: DataFrame, column: str) -> DataFrame:
    return consignors.join(made, "ct_consign_id", "left").select(
        *[F.coalesce(column, "_made").alias(column) if c == column else F.col(c) for c in consignors.columns]
    )


def validate_new_accounts(requests: DataFrame) -> DataFrame:
    """Requests (request_id, name, cash, consign_percent, consign_fee) with the reasons to refuse them.

    Blank and zero both count as missing. A fee replaces the percentage on cash accounts; credit
    accounts have no fee.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
    no_rate = F.coalesce("consign_percent", F.lit(0)) == 0
    no_fee = F.coalesce("consign_fee", F.lit(0)) == 0
    cash, rate = is_true("cash"), F.coalesce("consign_percent", F.lit(0).cast(RATE))
    reasons = F.array_compact(
        F.array(
            F.when(blank("name"), F.lit("name")),
            F.when(F.col("cash").isNull(), F.lit("account type")),
            F.when(no_rate & no_fee, F.lit("percent or fee")),
        )
    )
    return requests.select(
        *[c for c in requests.columns if c not in ("consign_percent", "consign_fee")],
        F.when(cash & ~no_fee, F.lit(0)).otherwise(rate).cast(RATE).alias("consign_percent"),
        F.when(cash & ~no_fee, F.col("consign_fee")).alias("consign_fee"),
        F.array_join(reasons, ", ").alias("missing"),
    )


def taken_ids(requests: DataFrame, existing: Accounts) -> DataFrame:
    """Valid requests whose own id is refused: an account has it, or a request before them asks for it too.

    Of several requests for an id the one with the smallest request id gets it.
    """
    valid = validate_new_accounts(requests).filter((F.col("missing") == "") & F.col("ct_consign_id").isNotNull())
    first = valid.groupBy("ct_consign_id").agg(F.min("request_id").alias("_first"))
    held = existing.consignors.select("ct_consign_id").distinct().withColumn("_held", F.lit(True))
    reason = F.when(F.col("_held"), "id exists").when(F.col("request_id") != F.col("_first"), "id asked for twice")
    return (
        valid.join(first, "ct_consign_id")
        .join(held, "ct_consign_id", "left")
        .select("request_id", "ct_consign_id", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def create_accounts(requests: DataFrame, existing: Accounts) -> Accounts:
    """Accounts for all valid requests: consignor, item, and a vendor or a customer each.

    A request may bring its own id; the others are numbered after the highest existing one. Requests with an
    id that is taken make nothing; ``taken_ids`` lists them.
    """
    valid = validate_new_accounts(requests).filter(F.col("missing") == "").drop("missing")
    refused = taken_ids(requests, existing).select("request_id")
    own_id = valid.filter(F.col("ct_consign_id").isNotNull()).join(refused, "request_id", "left_anti")
    highest = existing.consignors.select("ct_consign_id").unionByName(own_id.select("ct_consign_id"))
    numbered = next_ids(
        highest, "ct_consign_id", valid.filter(F.col("ct_consign_id").isNull()).drop("ct_consign_id"),
        ["request_id"], "ct_consign_id",
    )
    every = numbered.unionByName(own_id)
    made = fan_out_accounts(every, existing.vendors, existing.customers)
    consignors = made.consignors.drop("name", "cash", "consign_percent").join(every, "ct_consign_id").select(
        "request_id", "ct_consign_id", "name", "cash", "consign_percent", "consign_fee", "item_id",
        "vendor_id", "customer_id",
    )
    vendors = made.vendors.withColumn("legal_name", legal_name(F.col("name")))
    return Accounts(consignors, made.items, vendors, made.customers)
