"""Reconciliation and repair jobs over names, dates, balances and whole transaction kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import is_true
from .balances import balances_by_consignor
from .entries import (
    CARD_IMPORT, CONSIGNOR, CORRECTION, EARNINGS, GIFT, OPENING, RECEIVABLE, SETUP, credit, debit, emit,
)


def name_drift(consignors: DataFrame, vendors: DataFrame, customers: DataFrame) -> DataFrame:
    """Vendors and customers whose name differs from their consignor's; unknown names are left alone."""
    def differing(records, kind, key, column):
        linked = consignors.select(F.col(key).alias("ref_id"), F.col("name").alias("new_name"))
        held = records.select(F.col(key).alias("ref_id"), F.col(column).alias("old_name"))
        return (
            held.join(linked, "ref_id")
            .filter(F.col("new_name") != F.col("old_name"))
            .select(F.lit(kind).alias("ref"), "ref_id", "old_name", "new_name")
        )

    return differing(vendors, "vendor", "vendor_id", "name").unionByName(
        differing(customers, "customer", "customer_id", "company")
    )


def apply_names(records: DataFrame, drift: DataFrame, kind: str, key: str, column: str) -> DataFrame:
    """Records of one kind with the corrected names."""
    fixed = drift.filter(F.col("ref") == kind).select(F.col("ref_id").alias(key), "new_name")
    return records.join(fixed, key, "left").select(
        *[F.coalesce("new_name", column).alias(column) if c == column else F.col(c) for c in records.columns]
    )


def propagate_name_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names to write to vendors and customers for consignors renamed between two snapshots."""
    old = before.select("ct_consign_id", F.col("name").alias("_old"))
    renamed = after.join(old, "ct_consign_id").filter(F.col("name") != F.col("_old"))
    def target(kind, key):
        return F.when(
            F.col(key).isNotNull(), F.struct(F.lit(kind).alias("ref"), F.col(key).alias("ref_id"))
        )

    targets = F.array_compact(F.array(target("vendor", "vendor_id"), target("customer", "customer_id")))
    return renamed.select(F.col("name").alias("new_name"), F.explode(targets).alias("_t")).select(
        "_t.ref", "_t.ref_id", "new_name"
    )


def payment_date_repair_set(
    lines: DataFrame, orders: DataFrame, invoices: DataFrame, order_payments: DataFrame,
    payments: DataFrame, card_payments: DataFrame, text: str,
) -> DataFrame:
    """Orders, invoices, payments and deposits behind manually entered card sales, with the true date."""
    # Several manual lines of an order repair the same documents, so each order counts once.
    manual = lines.filter(F.col("description") == text).select("order_id", "invoice_id").distinct()
    return (
        manual.join(orders.select("order_id", "created_ts"), "order_id")
        .join(invoices.select("invoice_id"), "invoice_id")
        .join(order_payments.select("order_id", "customer_payment_id"), "order_id")
        .join(payments.select("customer_payment_id", "deposit_id"), "customer_payment_id")
        .join(card_payments.select("customer_payment_id", "payment_date"), "customer_payment_id")
        .select("order_id", "created_ts", "invoice_id", "customer_payment_id", "deposit_id", "payment_date")
    )


def apply_dates(target: DataFrame, repairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Put the true date on the listed records; the earliest wins where a key has several."""
    one = repairs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("payment_date").alias("_date"))
    return target.join(one, key, "left").select(
        *[F.coalesce("_date", c).alias(c) if c in columns else F.col(c) for c in target.columns]
    )


def affected_transactions(repairs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Ledger transactions of the repaired invoices, payments and deposits, with the true date."""
    def hit(ref, key):
        return F.struct(F.lit(ref).alias("ref"), F.col(key).cast("bigint").alias("ref_id"))

    documents = F.array(
        hit("invoice", "invoice_id"), hit("customer_payment", "customer_payment_id"), hit("deposit", "deposit_id")
    )
    listed = repairs.select("payment_date", F.explode(documents).alias("_d")).select("payment_date", "_d.*")
    return listed.join(transactions.select("ref", "ref_id", "trans_id"), ["ref", "ref_id"]).select(
        "trans_id", "payment_date"
    )


def misfiled_balances(consignors: DataFrame, postings: DataFrame) -> DataFrame:
    """Accounts with both a vendor and a customer whose money lies on the wrong side."""
    both = consignors.filter(F.col("vendor_id").isNotNull() & F.col("customer_id").isNotNull())
    held = balances_by_consignor(both, postings, posted_only=False).filter(
        F.col("cash_balance").isNotNull() & F.col("credit_balance").isNotNull()
    )
    as_vendor, as_customer = F.col("cash_balance") != 0, F.col("credit_balance") != 0
    # An account of unknown type is listed when it holds any money.
    wrong = F.when(F.col("cash"), as_customer).when(~F.col("cash"), as_vendor).otherwise(as_vendor | as_customer)
    return held.filter(wrong).select(
        "ct_consign_id", "cash", "cash_balance", "credit_balance", "consign_percent", "vendor_id", "customer_id"
    )


def misfiled_corrections(misfiled: DataFrame) -> DataFrame:
    """Postings that move misfiled balances: to the customer of credit accounts, the vendor of cash ones."""
    vendor, customer = ("vendor", F.col("vendor_id")), ("customer", F.col("customer_id"))
    as_vendor, as_customer, cash = F.col("cash_balance"), F.col("credit_balance"), F.col("cash")
    to_customer = ~cash & (as_vendor != 0)
    to_vendor = cash & (as_customer != 0)
    return emit(
        misfiled,
        {
            "trans_ref": F.lit("ct_consign"),
            "trans_ref_id": "ct_consign_id",
            "description": F.lit(CORRECTION),
        },
        F.when(to_customer, debit(*vendor, CONSIGNOR, as_vendor)),
        F.when(to_customer, credit(*customer, CONSIGNOR, as_vendor)),
        F.when(to_vendor, debit(*customer, CONSIGNOR, as_customer)),
        F.when(to_vendor, credit(*vendor, CONSIGNOR, as_customer)),
    )


def ar_reversal(postings: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """Write receivables of posted invoices off to retained earnings, one new transaction each.

    Every posted invoice gets a set-up transaction dated by its post date, which its postings carry.
    ``batch`` (invoice_id) restricts the run to one batch of invoices.
    """
    receivable = postings.filter((F.col("account") == RECEIVABLE) & (F.col("trans_ref") == "invoice")).filter(
        F.col("post_date").isNotNull()
    ).select("trans_ref_id", "ref", "ref_id", "debit", F.col("post_date").alias("ref_date"))
    if batch is not None:
        receivable = receivable.join(batch.select(F.col("invoice_id").alias("trans_ref_id")), "trans_ref_id", "left_semi")
    party = (F.col("ref"), F.col("ref_id"))
    return emit(
        receivable,
        {
            "trans_ref": F.lit("invoice"),
            "trans_ref_id": "trans_ref_id",
            "ref_date": "ref_date",
            "description": F.lit(SETUP),
        },
        credit(*party, RECEIVABLE, F.col("debit")),
        debit(*party, EARNINGS, F.col("debit")),
    )


def opening_balances(staging: DataFrame, consignors: DataFrame) -> DataFrame:
    """Staged non-zero balances (ct_id, balance) as opening postings of each consignor's own side."""
    cash = is_true("cash")
    open_ones = staging.filter(F.col("balance") != 0).join(
        consignors, F.col("ct_id") == F.col("ct_consign_id")
    )
    ref = F.when(cash, "vendor").otherwise("customer")
    party = F.when(cash, F.col("vendor_id")).otherwise(F.col("customer_id"))
    return emit(
        open_ones,
        {
            "trans_ref": F.lit("ct_consign"),
            "trans_ref_id": "ct_consign_id",
            "description": F.lit(OPENING),
        },
        credit(ref, party, CONSIGNOR, F.col("balance")),
        debit(ref, party, EARNINGS, F.col("balance")),
    )


def gift_opening(cards: DataFrame, staging: DataFrame) -> DataFrame:
    """Opening postings of loaded gift cards, matched to their staged balance by the old code."""
    held = staging.select("legacy_code", F.col("balance").alias("_balance"))
    party = ("gift_card", F.col("gift_card_id"))
    rows = emit(
        cards.join(held, "legacy_code"),
        {
            "trans_ref": F.lit("gift_card"),
            "trans_ref_id": "gift_card_id",
            "description": F.lit(CARD_IMPORT),
            "memo": "name",
        },
        credit(*party, GIFT, F.col("_balance")),
        debit(*party, EARNINGS, F.col("_balance")),
    )
    return rows


def purge_by_ref(transactions: DataFrame, postings: DataFrame, ref: str) -> tuple[DataFrame, DataFrame]:
    """Transactions and postings without those of one kind of document."""
    def others(column: str) -> Column:
        return ~F.col(column).eqNullSafe(F.lit(ref))

    return transactions.filter(others("ref")), postings.filter(others("trans_ref"))


def clear_links(records: DataFrame, column: str) -> DataFrame:
    """Take a link to purged documents off every record."""
    return records.withColumn(column, F.lit(None).cast(records.schema[column].dataType))


# The account fields whose edits are logged.
LOGGED_FIELDS = ("name", "cash", "consign_percent", "consign_fee")


def _logged_text(field: str) -> Column:
    """A field as the log shows it; unknown is blank."""
    return F.coalesce(F.col(field).cast("string"), F.lit(""))


def change_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """One log row per account field changed between two snapshots."""
    old = before.select("ct_consign_id", *[_logged_text(f).alias(f"_old_{f}") for f in LOGGED_FIELDS])
    new = after.select("ct_consign_id", *[_logged_text(f).alias(f"_new_{f}") for f in LOGGED_FIELDS])

    def change(field):
        was, now = F.col(f"_old_{field}"), F.col(f"_new_{field}")
        words = F.concat(F.lit(f"{field} changed from "), was, F.lit(" to "), now)
        return F.when(was != now, F.struct(F.lit(field).alias("field"), words.alias("message")))

    changes = F.array(*[change(f) for f in LOGGED_FIELDS])
    return (
        old.join(new, "ct_consign_id")
        .select("ct_consign_id", F.explode(changes).alias("_c"))
        .filter(F.col("_c").isNotNull())
        .select("ct_consign_id", "_c.*")
    )


def account_activity(logs: DataFrame, notes: DataFrame) -> DataFrame:
    """Log and note entries per consignor account, newest first within an account."""
    columns = [F.col("ref_id").alias("ct_consign_id"), "created_ts", "message"]
    entries = [
        df.filter(F.col("ref") == "ct_consign").select(F.lit(kind).alias("kind"), *columns)
        for kind, df in (("log", logs), ("note", notes))
    ]
    return reduce(DataFrame.unionByName, entries).orderBy("ct_consign_id", "kind", F.desc("created_ts"))


def recent_activity(logs: DataFrame, notes: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` entries of each account and kind, numbered from the newest; entries of one instant by id.

    Every task keeps ``most`` entries of an account before anything is shuffled, so a busy account is no bottleneck.
    """
    entries = [
        df.filter(F.col("ref") == "ct_consign").select(
            F.col("ref_id").alias("ct_consign_id"), F.lit(kind).alias("kind"), "entry_id", "created_ts", "message"
        )
        for kind, df in (("log", logs), ("note", notes))
    ]
    newest = Window.partitionBy("ct_consign_id", "kind").orderBy(F.desc("created_ts"), F.desc("entry_id"))
    every = reduce(DataFrame.unionByName, entries).withColumn("place", F.row_number().over(newest))
    return every.filter(F.col("place") <= most)


def reject_invalid_discounts(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """Discount requests (request_id, order_id, percent as text) that must be refused, with the reason."""
    heads = orders.select("order_id", "close_ts", "discount")
    reason = (
        F.when(F.col("close_ts").isNotNull(), "order is closed")
        .when(F.coalesce("discount", F.lit(0)) != 0, "order is already discounted")
        .when(~F.coalesce("percent", F.lit("")).rlike("^[0-9]{1,2}$"), "not a valid discount")
    )
    return (
        requests.join(heads, "order_id", "left")
        .select("request_id", "order_id", "percent", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


