"""Edits of consignor accounts: the changed fields, the parties an account then needs, its moved balance and the log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import next_ids
from ..functions.money import PRICE, RATE, is_true
from .payouts import conversion_log
from .repairs import LOGGED_FIELDS, change_log

TYPES = {"name": "string", "cash": "boolean", "consign_percent": RATE, "consign_fee": PRICE}


class Edited(NamedTuple):
    """Accounts after a round of edits, and what had to be made for them."""

    consignors: DataFrame
    vendors: DataFrame
    customers: DataFrame
    type_changes: DataFrame


def last_edits(edits: DataFrame) -> DataFrame:
    """One row (ct_consign_id, typed) per account: of several edits the one with the highest ``edit_id``."""
    typed = [F.col(field).cast(kind).alias(field) for field, kind in TYPES.items()]
    return edits.groupBy("ct_consign_id").agg(F.max(F.struct("edit_id", *typed)).alias("typed"))


def _changed(field: str) -> Column:
    """Whether a field was typed differently; unknown and blank are the same."""
    text = lambda c: F.coalesce(F.col(c).cast(TYPES[field]).cast("string"), F.lit(""))
    return F.col("typed").isNotNull() & (text(field) != text(f"typed.{field}"))


def apply_edits(edits: DataFrame, consignors: DataFrame, vendors: DataFrame, customers: DataFrame) -> Edited:
    """Apply ``edits`` (edit_id, ct_consign_id, name, cash, consign_percent, consign_fee), each a whole form.

    A fee that is newly set puts the percentage to zero; any other edit clears the fee. An account that changes
    its type gets the vendor (cash) or customer (credit) it lacks, under the name it had. ``type_changes`` is what
    ``convert_account_type`` takes.
    """
    changed = {field: _changed(field) for field in LOGGED_FIELDS}
    any_change = F.array_contains(F.array(*changed.values()), True)
    fee_set = changed["consign_fee"] & (F.coalesce(F.col("typed.consign_fee"), F.lit(0)) != 0)
    new = {field: F.when(changed[field], F.col(f"typed.{field}")).otherwise(F.col(field)) for field in LOGGED_FIELDS}
    new["consign_percent"] = F.when(fee_set, F.lit(0)).otherwise(new["consign_percent"]).cast(RATE)
    new["consign_fee"] = F.when(fee_set, F.col("typed.consign_fee")).when(~any_change, F.col("consign_fee")).cast(PRICE)
    staged = consignors.join(last_edits(edits), "ct_consign_id", "left").select(
        *[c for c in consignors.columns if c not in LOGGED_FIELDS],
        *[F.col(field).alias(f"_old_{field}") for field in LOGGED_FIELDS],
        *[value.alias(field) for field, value in new.items()],
        changed["cash"].alias("_retyped"),
    )

    def made(existing: DataFrame, key: str, wanted: Column) -> DataFrame:
        lacking = staged.filter(F.col("_retyped") & wanted & F.col(key).isNull())
        return next_ids(existing, key, lacking.select("ct_consign_id", "_old_name"), ["ct_consign_id"], f"_{key}")

    new_vendors = made(vendors, "vendor_id", is_true("cash"))
    new_customers = made(customers, "customer_id", ~is_true("cash"))
    for key, found in (("vendor_id", new_vendors), ("customer_id", new_customers)):
        staged = staged.join(found.drop("_old_name"), "ct_consign_id", "left").withColumn(key, F.coalesce(key, f"_{key}"))
    return Edited(
        staged.select(*consignors.columns),
        new_vendors.select(
            F.col("_vendor_id").alias("vendor_id"), F.col("_old_name").alias("name"),
            F.col("ct_consign_id").cast("string").alias("account"),
        ),
        new_customers.select(F.col("_customer_id").alias("customer_id"), F.col("_old_name").alias("company")),
        staged.filter("_retyped").select(
            "ct_consign_id", "vendor_id", "customer_id", is_true("cash").alias("new_cash"),
            F.col("_old_consign_percent").alias("old_percent"), F.col("consign_percent").alias("new_percent"),
        ),
    )


def edit_log(edits: DataFrame, consignors: DataFrame, converted: DataFrame) -> DataFrame:
    """(ct_consign_id, message) of every field typed differently and of every balance moved (``converted_balances``)."""
    after = last_edits(edits).select("ct_consign_id", "typed.*")
    before = consignors.select("ct_consign_id", *[F.col(field).cast(kind).alias(field) for field, kind in TYPES.items()])
    return change_log(before, after).select("ct_consign_id", "message").unionByName(conversion_log(converted))
