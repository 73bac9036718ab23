"""Building blocks for double-entry rows: one struct per side, exploded into posting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import money, zero

# Account codes.
CONSIGNOR, RECEIVABLE, PAYABLE, SALES = "cc", "ar", "ap", "sales"
TAX, GIFT, COST, EARNINGS, CASH, BANK = "tax", "gift", "cogs", "earn", "cash", "bank"

# Texts of the entries, lines and report rows made here.
OPENING = "Initial Balance"
SETUP = "Initial Setup"
CARD_IMPORT = "Gift Card Import"
TRANSFER = "Transfer account balance"
CASH_ADJUSTED = "Manual Cash Adjustment"
CREDIT_ADJUSTED = "Manual Credit Adjustment"
CORRECTION = "Cash/Credit Adjustment"
CHECK_VOIDED = "Void and cancel check"
VOID_MEMO = "void check"
CHECK_CONVERTED = "Convert Check to Customer Credit"
PAYOUT = "Consignment"
PAYOUT_OFFSET = "Consignment - Credit Transfer"
GIFT_LINE = "GiftCard"
ACCOUNT_LINE = "Account Payment"
UNNAMED_CARD = "unknown"
PREPAID = "Credit/Gift"
NO_CONSIGNOR = "Please enter store credit customer"
NO_CREDIT = "does not have a credit balance"
CHECK_LOG = "Check voided and canceled"
PAID = "Cash/Check/CC"


def _side(ref, ref_id, account, debit: Column, credit: Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(ref).cast("string").alias("ref"),
        as_column(ref_id).cast("bigint").alias("ref_id"),
        as_column(account).cast("string").alias("account"),
        debit.alias("debit"),
        credit.alias("credit"),
    )


def debit(ref, ref_id, account, amount: Column) -> Column:
    return _side(ref, ref_id, account, money(amount), zero())


def credit(ref, ref_id, account, amount: Column) -> Column:
    return _side(ref, ref_id, account, zero(), money(amount))


def emit(df: DataFrame, keep: dict[str, Column | str], *sides: Column) -> DataFrame:
    """One output row per non-NULL side, in a single pass; ``keep`` names the columns carried along."""
    kept = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in keep.items()]
    sided = df.select(*kept, F.explode(F.array(*sides)).alias("_side")).filter(F.col("_side").isNotNull())
    return sided.select(*keep, "_side.*")
