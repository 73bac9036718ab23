"""Posting rules on hand-computed tables."""

import datetime as dt

import fixtures as fx
import pytest
from fixtures import D

from shelfbook.operators import ledger, payments, payouts, repairs

DAY = dt.date(2013, 5, 1)


@pytest.fixture(scope="module")
def book(spark):
    consignors = fx.consignors(
        spark,
        (1, True, 101, None, "0.5000", None),
        (2, False, None, 22, "0.3333", None),
        (3, True, 103, 33, "0.0000", "2.00"),
    )
    lines = fx.lines(
        spark,
        # Invoice 1: one line of each kind
        fx.line(1, 1, "gift_card", None, None, 1, "10.00"),
        fx.line(1, 2, "gift_card", None, 900, 1, "20.00"),
        fx.line(1, 3, "pay_account", None, None, 1, "30.00"),
        fx.line(1, 4, "item", None, None, 1, "40.00"),
        fx.line(1, 5, "gift_card", 3, None, 1, "50.00"),
        fx.line(1, 6, "gift_card", 99, None, 1, "60.00"),
        fx.line(1, 7, "item", 1, None, 2, "5.00", tax="0.80"),
        fx.line(1, 8, "pay_account", 2, None, 1, "7.00"),
        # Invoice 2: shares are rounded once, after the sum; unknown tax posts nothing
        fx.line(2, 1, "item", 1, None, 1, "0.01", tax=None),
        fx.line(2, 2, "item", 1, None, 1, "0.02", tax=None),
        fx.line(2, 3, "item", 3, None, 3, "10.00", tax=None),
        # Never billed
        fx.line(3, 1, "item", 1, None, 1, "99.00"),
    )
    return consignors, lines, fx.invoices(spark, (1, 70), (2, 71))


def test_routing_of_each_kind_of_line(book):
    consignors, lines, invoices = book
    got = fx.rows(ledger.invoice_revenue(lines.filter("order_id = 1"), invoices, consignors), "ref", "ref_id", "account", "credit")
    assert got == fx.rows_like(
        ("invoice", 1, "gift", "10.00"),
        ("gift_card", 900, "gift", "20.00"),
        ("customer", 70, "cc", "30.00"),
        ("customer", 70, "sales", "40.00"),
        ("customer", 33, "cc", "50.00"),
        ("customer", None, "cc", "60.00"),
        ("item", 1, "sales", "10.00"),
        ("item", 2, "sales", "7.00"),
    )


def test_shares_use_fee_or_percent_and_round_after_the_sum(book):
    consignors, lines, invoices = book
    got = fx.rows(ledger.consignor_share(lines, invoices, consignors), "invoice_id", "ref", "ref_id", "amount")
    assert got == fx.rows_like(
        (1, "vendor", 101, "5.00"),
        (1, "customer", 22, "2.33"),
        (2, "vendor", 101, "0.02"),  # half of 0.03; two rounded halves would be 0.01 + 0.01
        (2, "vendor", 103, "24.00"),  # 3 × (10.00 − 2.00)
    )


def test_tax_is_left_out_when_zero_or_unknown(book):
    _, lines, invoices = book
    assert fx.rows(ledger.invoice_tax(lines, invoices), "invoice_id", "ref", "credit") == [(1, None, "0.80")]


def test_one_pass_posting_equals_its_parts(book):
    consignors, lines, invoices = book
    parts = (
        ledger.invoice_revenue(lines, invoices, consignors)
        .unionByName(ledger.invoice_tax(lines, invoices))
        .unionByName(ledger.invoice_receivable(lines, invoices))
        .unionByName(ledger.consignor_entries(ledger.consignor_share(lines, invoices, consignors)))
    )
    whole = ledger.post_invoices(lines, invoices, consignors)
    assert fx.rows(whole) == fx.rows(parts.select(*whole.columns))
    assert ledger.ledger_balance_check(whole, ["invoice_id"]).count() == 0
    assert {r.ref_date for r in whole.select("ref_date").distinct().collect()} == {DAY}


def test_billing_keeps_earlier_invoices_unless_asked(spark):
    rows = [fx.line(1, 1, "item", 1, None, 1, "1.00")[:-2] + ("other", 5), fx.line(1, 2, "item", 1, None, 1, "1.00")[:-2] + (None, None)]
    lines, invoices = fx.lines(spark, *rows), fx.invoices(spark, (1, 70))
    assert fx.rows(ledger.bill_lines(lines, invoices), "line_number", "invoice_id", "account") == [(1, 5, "other"), (2, 1, "sales")]
    assert fx.rows(ledger.bill_lines(lines, invoices, rebill=True), "line_number", "invoice_id", "account") == [(1, 1, "sales"), (2, 1, "sales")]


def test_reposting_takes_the_earliest_date(spark):
    trans = spark.createDataFrame([(1, DAY, DAY), (2, DAY, None), (3, DAY, DAY)], "trans_id bigint, ref_date date, post_date date")
    dates = spark.createDataFrame([(1, dt.date(2013, 3, 2)), (1, dt.date(2013, 3, 1)), (2, dt.date(2013, 4, 1))], "trans_id bigint, new_date date")
    got = fx.rows(ledger.repost_with_new_date(trans, dates))
    assert got == [(1, dt.date(2013, 3, 1), dt.date(2013, 3, 1)), (2, dt.date(2013, 4, 1), dt.date(2013, 4, 1)), (3, DAY, DAY)]


def test_every_kind_of_entry_balances(shop):
    sound = [
        (shop.invoice_postings, ["invoice_id"]),
        (ledger.payment_entries(shop.customer_payments, shop.methods), ["trans_ref_id"]),
        (repairs.opening_balances(shop.opening_staging, shop.consignors.drop("name")), ["trans_ref_id"]),
        (repairs.misfiled_corrections(repairs.misfiled_balances(shop.consignors, shop.postings)), ["trans_ref_id"]),
        (repairs.ar_reversal(shop.postings), ["trans_ref_id"]),
    ]
    for entries, keys in sound:
        assert entries.count() > 0
        assert ledger.ledger_balance_check(entries, keys).count() == 0


def test_vouchers_balance_and_keep_lines_apart(spark):
    columns = "vendor_id bigint, ref_num string, line_number int, ref string, ref_id bigint, account string, qty int, unit_cost decimal(20,2)"
    lines = spark.createDataFrame(
        [(1, "1-x", 1, "vendor", 1, "cc", 1, D("90.00")), (1, "1-x", 2, "vendor", 1, "cc", 1, D("90.00")), (1, "1-x", 3, "customer", 5, "cc", 1, D("-30.00"))],
        columns,
    )
    got = fx.rows(ledger.voucher_entries(lines), "ref", "ref_id", "account", "debit", "credit")
    assert got == fx.rows_like(
        ("vendor", 1, "cc", "90.00", "0.00"), ("vendor", 1, "cc", "90.00", "0.00"),
        ("customer", 5, "cc", "-30.00", "0.00"), ("vendor", 1, "ap", "0.00", "150.00"),
    )


def test_store_credit_of_cash_accounts_moves_to_the_vendor(spark):
    entries = spark.createDataFrame(
        [("customer_payment", 1, "customer", 33, "cc", D("5.00"), D("0.00")), ("customer_payment", 1, "customer", 33, "ar", D("0.00"), D("5.00")),
         ("customer_payment", 2, "customer", 22, "cc", D("6.00"), D("0.00"))],
        "trans_ref string, trans_ref_id bigint, ref string, ref_id bigint, account string, debit decimal(20,2), credit decimal(20,2)",
    )
    paid = spark.createDataFrame([(1, 33), (2, 22)], "customer_payment_id bigint, customer_id bigint")
    owners = fx.consignors(spark, (2, False, 102, 22, "0.1", None), (3, True, 103, 33, "0.1", None))
    got = fx.rows(payments.reclass_payment_postings(entries, paid, owners), "customer_payment_id", "ref", "ref_id", "account")
    assert got == fx.rows_like((1, "vendor", 103, "cc"), (1, "customer", 33, "ar"), (2, "customer", 22, "cc"))


def test_conversion_scales_by_the_change_in_rate(spark):
    changes = spark.createDataFrame(
        [(1, 101, 11, True, D("0.4000"), D("0.5000")), (2, 102, 12, False, D("0.5000"), D("0.4000")),
         (3, 103, 13, True, D("0.4000"), D("0.4000")), (4, 104, 14, True, D("0.4000"), D("0.5000"))],
        "ct_consign_id bigint, vendor_id bigint, customer_id bigint, new_cash boolean, old_percent decimal(5,4), new_percent decimal(5,4)",
    )
    held = fx.postings(
        spark, (1, True, "customer", 11, "cc", "0.00", "100.00"), (2, False, "vendor", 102, "cc", "0.00", "110.00"),
        (3, True, "customer", 13, "cc", "0.00", "10.00"), (4, True, "customer", 14, "cc", "5.00", "5.00"),
    )
    got = fx.rows(payouts.convert_account_type(changes, held), "trans_ref_id", "ref", "ref_id", "account", "debit", "credit")
    assert got == fx.rows_like(
        (1, "customer", 11, "cc", "100.00", "0.00"), (1, "vendor", 101, "cc", "0.00", "110.00"), (1, None, None, "cogs", "10.00", "0.00"),
        (2, "vendor", 102, "cc", "110.00", "0.00"), (2, "customer", 12, "cc", "0.00", "100.00"), (2, None, None, "cogs", "-10.00", "0.00"),
        (3, "customer", 13, "cc", "10.00", "0.00"), (3, "vendor", 103, "cc", "0.00", "10.00"),
    )
    odd = fx.rows(payouts.convert_account_type(changes, held, unchanged_counts_as_zero=True).filter("trans_ref_id = 3"), "ref", "debit", "credit")
    assert odd == fx.rows_like(("customer", "10.00", "0.00"), ("vendor", "0.00", "7.14"), (None, "-2.86", "0.00"))


@pytest.mark.parametrize("accounts", [("cc",), ("cc", "ap"), ("gift",), ("ar",), ("sales", "tax"), ("cogs",), ("none",)])
def test_postings_of_some_accounts_are_those_of_the_whole_ledger(shop, accounts):
    whole = shop.postings.filter(shop.postings.account.isin(*accounts))
    some = type(shop)(shop.spark, shop.sf_dir).postings_of(*accounts)
    assert some.columns == whole.columns
    assert some.exceptAll(whole).isEmpty() and whole.exceptAll(some).isEmpty()


def test_accounts_that_need_no_invoice_totals_make_none(shop):
    fresh = type(shop)(shop.spark, shop.sf_dir)
    plan = lambda *accounts: fresh.postings_of(*accounts)._jdf.queryExecution().optimizedPlan().toString()
    assert "tax_amount" not in plan("cc")
    assert "tax_amount" in plan("ar")


def test_only_balanced_transactions_are_posted(spark):
    day = dt.date(2013, 5, 1)
    kind = "trans_id bigint, ref string, ref_id bigint, ref_date date, post_date date"
    transactions = spark.createDataFrame(
        [(1, "a", 1, day, None), (2, "a", 2, day, None), (3, "a", 3, day, day), (4, "a", 4, day, None), (5, "a", 5, day, day), (6, "a", 6, None, None)], kind
    )
    book = fx.postings(
        spark, (1, False, None, None, "x", "1.10", "0"), (1, False, None, None, "y", "0", "1.00"), (1, False, None, None, "y", "0", "0.10"),
        (2, False, None, None, "x", "1.10", "0"), (2, False, None, None, "y", "0", "1.00"), (3, True, None, None, "x", "5.00", "0"),
        (5, True, None, None, "x", "2.00", "2.00"), (99, True, None, None, "x", "7.00", "0"),
    )
    done = ledger.post_balanced(transactions, book)
    assert done.transactions.columns == transactions.columns
    assert fx.rows(done.transactions, "trans_id", "post_date") == [(1, day), (2, None), (3, day), (4, day), (5, day), (6, None)]
    assert fx.rows(done.refused) == [(2, "a", 2, "1.10", "1.00")]
    new = dt.date(2013, 7, 7)
    dates = spark.createDataFrame([(2, new), (3, new), (3, dt.date(2013, 8, 1)), (5, new), (6, None), (77, new)], "trans_id bigint, new_date date")
    again = ledger.repost_balanced(transactions, dates, book)
    assert fx.rows(again.transactions, "trans_id", "ref_date", "post_date") == [
        (1, day, None), (2, new, None), (3, new, None), (4, day, None), (5, new, new), (6, None, None)
    ]
    assert fx.rows(again.refused, "trans_id", "debit", "credit") == [(2, "1.10", "1.00"), (3, "5.00", "0.00")]
    assert ledger.post_balanced(transactions.limit(0), book).transactions.count() == 0
