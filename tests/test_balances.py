"""Balances, credit positions and payouts on hand-computed tables."""

import datetime as dt

import fixtures as fx
import pytest
from fixtures import D

from shelfbook.operators import balances, payments, payouts, repairs

OLD, CUT = dt.date(2013, 1, 1), dt.date(2013, 5, 1)


@pytest.fixture(scope="module")
def accounts(spark):
    return fx.consignors(
        spark,
        (1, True, 101, 11, "0.5", None),
        (2, False, 102, 12, "0.5", None),
        (3, True, 103, None, "0.5", None),
        (4, False, None, None, "0.5", None),
    )


@pytest.fixture(scope="module")
def book(spark):
    return fx.postings(
        spark,
        (1, OLD, "vendor", 101, "cc", "0.00", "300.00"),
        (2, OLD, "customer", 11, "cc", "80.00", "0.00"),
        (3, None, "vendor", 101, "cc", "50.00", "0.00"),  # not posted yet
        (4, CUT, "vendor", 103, "cc", "0.00", "500.00"),  # posted on the pay date itself
        (5, OLD, "vendor", 103, "cc", "0.00", "100.00"),
        (6, OLD, "vendor", 102, "cc", "0.00", "0.00"),
        (7, OLD, "customer", 12, "cc", "0.00", "40.00"),
        (8, OLD, "vendor", 101, "ap", "0.00", "7.00"),
        (9, OLD, "vendor", 103, "ap", "5.00", "5.00"),
        (10, OLD, "item", 101, "cc", "0.00", "999.00"),  # another kind of party with the same id
    )


def test_posted_and_all_balances_differ(book):
    assert fx.rows(balances.vendor_cash_balance(book)) == fx.rows_like((101, "300.00"), (102, "0.00"), (103, "600.00"))
    assert (("vendor", 101, "250.00")) in fx.rows(balances.balance_all_postings(book))


def test_account_list_and_statement(accounts, book):
    listed = fx.rows(balances.account_list(accounts, book), "ct_consign_id", "cash_balance", "credit_balance", "total_balance")
    assert listed == fx.rows_like(
        (1, "300.00", "-80.00", "220.00"), (2, "0.00", "40.00", "40.00"), (3, "600.00", None, "600.00"), (4, None, None, "0.00")
    )
    stated = fx.rows(balances.account_statement_total(accounts, book), "ct_consign_id", "total_balance")
    assert stated == [(1, "220.00"), (2, "40.00"), (3, None), (4, None)]


def test_inactive_accounts_are_hidden_on_request(spark, book):
    both = fx.consignors(spark, (1, True, 101, 11, "0.5", None)).selectExpr(
        "* EXCEPT (inactive_ts)", "timestamp_ntz'2013-01-01' AS inactive_ts"
    )
    assert balances.account_list(both, book, show_all=False).count() == 0
    assert balances.account_list(both, book).count() == 1


def test_payout_limits_are_strict(spark, accounts, book):
    vendors = spark.createDataFrame([(101, "A"), (102, "B"), (103, "C")], "vendor_id bigint, name string")
    got = fx.rows(payouts.payout_candidates(book, vendors, accounts, "100.00", CUT))
    # 103 has exactly the minimum before the pay date; 101 is reduced by its customer debt
    assert got == [(101, "A", "220.00", "-80.00", 11)]
    lines = payouts.payout_voucher_lines(payouts.payout_candidates(book, vendors, accounts, "1.00", CUT), CUT)
    assert fx.rows(lines, "vendor_id", "line_number", "ref", "ref_id", "unit_cost") == fx.rows_like(
        (101, 1, "vendor", 101, "300.00"), (101, 2, "customer", 11, "-80.00"), (103, 1, "vendor", 103, "100.00")
    )
    review = fx.rows(payouts.payout_review(book, vendors, accounts, "1.00", CUT), "vendor_id", "ap_amount", "amount", "is_total")
    assert review == fx.rows_like((101, "7.00", "220.00", False), (103, None, "100.00", False), (None, None, "320.00", True))


def test_misfiled_accounts(accounts, spark):
    book = fx.postings(
        spark,
        (1, True, "vendor", 101, "cc", "0.00", "0.00"), (1, True, "customer", 11, "cc", "0.00", "9.00"),
        (1, None, "vendor", 102, "cc", "0.00", "4.00"), (1, True, "customer", 12, "cc", "0.00", "0.00"),
    )
    found = repairs.misfiled_balances(accounts, book)
    assert fx.rows(found, "ct_consign_id", "cash_balance", "credit_balance") == [(1, "0.00", "9.00"), (2, "4.00", "0.00")]
    moves = fx.rows(repairs.misfiled_corrections(found), "ref", "ref_id", "debit", "credit")
    assert moves == fx.rows_like(
        ("customer", 11, "9.00", "0.00"), ("vendor", 101, "0.00", "9.00"), ("vendor", 102, "4.00", "0.00"), ("customer", 12, "0.00", "4.00")
    )


@pytest.mark.parametrize(
    ("due", "credit", "paid", "apply", "remaining"),
    [
        ("50.00", "80.00", None, "50.00", None),
        ("50.00", "30.00", None, "30.00", None),
        ("50.00", "-30.00", None, "-30.00", None),
        ("50.00", "50.00", None, "0.00", None),  # equal applies nothing
        ("0.00", "80.00", None, "0.00", None),
        ("-5.00", "80.00", None, "0.00", None),
        ("50.00", "80.00", "10.00", "50.00", "70.00"),
        ("50.00", "60.00", "10.00", "0.00", "50.00"),
    ],
)
def test_credit_position_branches(spark, accounts, due, credit, paid, apply, remaining):
    owed = spark.createDataFrame(
        [(1, 11, D(due), D(paid) if paid else None)],
        "order_id bigint, customer_id bigint, balance_due decimal(20,2), store_credit_payments decimal(20,2)",
    )
    # The customer's own and the linked vendor balance count together.
    book = fx.postings(spark, (1, None, "customer", 11, "cc", "10.00", "0.00"), (2, True, "vendor", 101, "cc", "0.00", str(D(credit) + 10)))
    got = fx.rows(balances.order_credit_position(owed, accounts, book), "apply_credit_balance", "remaining_balance")
    assert got == [(apply, remaining)]
    if due == credit:
        full = balances.order_credit_position(owed, accounts, book, equal_applies=True)
        assert fx.rows(full, "apply_credit_balance") == [(due,)]


@pytest.mark.parametrize(
    ("cash", "held", "asked", "amount", "short", "overdraw"),
    [
        (True, "-1.00", "10.00", "0.00", True, False),
        (False, "4.00", "10.00", "4.00", True, True),
        (True, "10.00", "10.00", "10.00", False, False),
        (False, "-5.00", "-3.00", "-3.00", False, False),
    ],
)
def test_store_credit_split(spark, cash, held, asked, amount, short, overdraw):
    available = spark.createDataFrame([(1, 7, cash, D(held))], "order_id bigint, ct_consign_id bigint, cash boolean, balance decimal(20,2)")
    requests = spark.createDataFrame([(1, D(asked))], "order_id bigint, requested decimal(20,2)")
    got = fx.rows(payments.split_store_credit(requests, available), "amount", "insufficient", "may_overdraw")
    assert got == [(amount, short, overdraw)]


def test_card_numbers_win_over_old_codes(spark):
    cards = spark.createDataFrame([(5, "S001"), (7, "005"), (9, "7")], "gift_card_id bigint, legacy_code string")
    codes = spark.createDataFrame([("5",), ("005",), ("7",), ("S001",), ("x",)], "code string")
    got = dict(fx.rows(balances.gift_card_lookup(codes, cards), "code", "gift_card_id"))
    assert got == {"5": 5, "005": 5, "7": 7, "S001": 5, "x": None}
