"""Small hand-made tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

D = Decimal
DAY = dt.date(2013, 5, 1)

CONSIGNORS = (
    "ct_consign_id bigint, item_id bigint, name string, cash boolean, vendor_id bigint, customer_id bigint, "
    "consign_percent decimal(5,4), consign_fee decimal(10,2), inactive_ts timestamp_ntz"
)
LINES = (
    "order_id bigint, line_number int, item_type string, item_id bigint, gift_card_id bigint, qty int, "
    "unit_price decimal(10,2), total_price decimal(20,2), tax_amount decimal(20,2), discounted boolean, "
    "account string, invoice_id bigint"
)
INVOICES = "invoice_id bigint, order_id bigint, customer_id bigint, created_ts timestamp_ntz"
POSTINGS = (
    "trans_id bigint, post_date date, ref string, ref_id bigint, account string, debit decimal(20,2), "
    "credit decimal(20,2)"
)


def consignors(spark, *rows):
    """Rows of (id, cash, vendor, customer, percent, fee)."""
    full = [(i, i, f"Name {i}", cash, v, c, D(p), D(f) if f else None, None) for i, cash, v, c, p, f in rows]
    return spark.createDataFrame(full, CONSIGNORS)


def line(order, number, kind, item, card, qty, price, tax="0.00", account="sales", discounted=None):
    tax = D(tax) if tax is not None else None
    return (order, number, kind, item, card, qty, D(price), qty * D(price), tax, discounted, account, order)


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), LINES)


def invoices(spark, *rows):
    """Rows of (invoice, customer); the order has the invoice's number."""
    return spark.createDataFrame([(i, i, c, dt.datetime(2013, 5, 1, 23, 59)) for i, c in rows], INVOICES)


def postings(spark, *rows):
    """Rows of (transaction, posted, ref, ref_id, account, debit, credit); ``posted`` may be a date."""
    def posted(value):
        return value if isinstance(value, dt.date) else DAY if value else None

    full = [(t, posted(p), r, i, a, D(d), D(c)) for t, p, r, i, a, d, c in rows]
    return spark.createDataFrame(full, POSTINGS)


def rows(df, *columns):
    """Values in any order, decimals as text."""
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(f"{v:f}" if isinstance(v, Decimal) else v for v in row) for row in picked.collect()),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def rows_like(*expected):
    return sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))
