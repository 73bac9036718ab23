"""Account edits and store credit of named consignors on hand-computed tables."""

import fixtures as fx
from fixtures import D

from shelfbook.operators import edits, payments, payouts

FORMS = (
    "edit_id bigint, ct_consign_id bigint, name string, cash boolean, consign_percent decimal(5,4), consign_fee decimal(10,2)"
)


def parties(spark):
    return spark.createDataFrame([(200,)], "vendor_id bigint"), spark.createDataFrame([(50,)], "customer_id bigint")


def test_a_fee_replaces_the_rate_and_any_other_edit_clears_the_fee(spark):
    people = fx.consignors(
        spark, (1, True, 101, None, "0.4000", None), (2, True, 102, None, "0.4000", "5.00"), (3, True, 103, None, "0.4000", "5.00"),
        (4, True, 104, None, "0.4000", "5.00"), (5, True, 105, None, "0.4000", "5.00"),
    )
    forms = spark.createDataFrame(
        [
            (1, 1, "Name 1", True, D("0.4000"), D("3.00")),  # a fee is set
            (2, 2, "New", True, D("0.4000"), D("5.00")),  # only the name is typed differently
            (3, 3, "Name 3", True, D("0.4000"), D("5.00")),  # nothing is
            (4, 4, "Name 4", True, D("0.4000"), None),  # the fee is taken away
        ],
        FORMS,
    )
    after = edits.apply_edits(forms, people, *parties(spark)).consignors
    assert after.columns == people.columns
    assert fx.rows(after, "ct_consign_id", "name", "consign_percent", "consign_fee") == [
        (1, "Name 1", "0.0000", "3.00"), (2, "New", "0.4000", None), (3, "Name 3", "0.4000", "5.00"),
        (4, "Name 4", "0.4000", None), (5, "Name 5", "0.4000", "5.00"),
    ]


def test_the_last_form_counts_and_a_changed_type_moves_the_balance(spark):
    people = fx.consignors(spark, (1, True, 101, None, "0.4000", None), (2, False, None, 22, "0.4000", None), (3, True, 103, 33, "0.4000", None))
    forms = spark.createDataFrame(
        [
            (9, 1, "Name 1", False, D("0.5000"), None), (8, 1, "Draft", True, D("0.1000"), None),
            (1, 2, "Renamed", True, D("0.4000"), None), (2, 3, "Name 3", False, D("0.4000"), None),
        ],
        FORMS,
    )
    vendors, customers = parties(spark)
    done = edits.apply_edits(forms, people, vendors, customers)
    assert fx.rows(done.consignors, "ct_consign_id", "name", "cash", "vendor_id", "customer_id") == [
        (1, "Name 1", False, 101, 51), (2, "Renamed", True, 201, 22), (3, "Name 3", False, 103, 33)
    ]
    assert fx.rows(done.vendors, "vendor_id", "name", "account") == [(201, "Name 2", "2")]
    assert fx.rows(done.customers, "customer_id", "company") == [(51, "Name 1")]
    book = fx.postings(spark, (1, True, "vendor", 101, "cc", "0.00", "100.00"), (2, True, "customer", 22, "cc", "0.00", "70.00"))
    moved = payouts.converted_balances(done.type_changes, book)
    assert fx.rows(moved, "ct_consign_id", "new_ref", "new_id", "new_balance") == [(1, "customer", 51, "110.00"), (2, "vendor", 201, "70.00")]
    # The other reading takes the unedited 40 percent as none at all: 70 / 1.4.
    unedited = payouts.converted_balances(done.type_changes, book, unchanged_counts_as_zero=True)
    assert fx.rows(unedited, "ct_consign_id", "new_balance") == [(1, "110.00"), (2, "50.00")]
    assert fx.rows(edits.edit_log(forms, people, moved), "ct_consign_id", "message") == [
        (1, "Converted cash balance of 100.00 to credit balance of 110.00 (change of 10.00)"),
        (1, "cash changed from true to false"), (1, "consign_percent changed from 0.4000 to 0.5000"),
        (2, "Converted credit balance of 70.00 to cash balance of 70.00 (change of 0.00)"),
        (2, "cash changed from false to true"), (2, "name changed from Name 2 to Renamed"),
        (3, "cash changed from true to false"),
    ]


def test_store_credit_of_named_consignors(spark):
    people = fx.consignors(
        spark, (1, True, 101, None, "0.4", None), (2, False, None, 22, "0.4", None), (3, False, None, None, "0.4", None)
    )
    orders = spark.createDataFrame([(1, 7), (2, 22), (3, 7), (4, 7), (5, 7), (6, 7), (7, 7)], "order_id bigint, customer_id bigint")
    requests = spark.createDataFrame(
        [
            (1, 1, 1, D("30.00"), None), (2, 1, 1, D("40.00"), None),  # a vendor only; asked twice
            (3, 2, 1, D("5.00"), None),  # the order has its own customer
            (4, 3, 3, D("5.00"), None), (5, 4, None, D("5.00"), None), (6, 5, 99, D("5.00"), None),
            (7, 6, 1, D("500.00"), D("200.00")),  # a cash account pays what it holds at most
            (8, 7, 2, D("500.00"), None),  # falls short, no other amount given
        ],
        "request_id bigint, order_id bigint, ct_consign_id bigint, requested decimal(20,2), use_amount decimal(20,2)",
    )
    book = fx.postings(spark, (1, True, "vendor", 101, "cc", "0.00", "100.00"), (2, False, "customer", 22, "cc", "0.00", "8.00"))
    customers, methods = parties(spark)[1], spark.createDataFrame([(3, True)], "payment_method_id bigint, store_credit boolean")
    paid = spark.createDataFrame([(1, 2, 3, D("6.00"))], "order_payment_id bigint, order_id bigint, payment_method_id bigint, amount decimal(20,2)")
    walk_in = spark.createDataFrame([(7,)], "customer_id bigint")
    done = payments.named_store_credit(requests, orders, people, customers, walk_in, book, paid, methods)
    assert fx.rows(done.payments, "order_id", "ct_consign_id", "customer_id", "balance", "amount", "insufficient") == [
        (1, 1, 51, "100.00", "40.00", False), (2, 2, 22, "2.00", "2.00", True), (6, 1, 51, "100.00", "100.00", True),
        (7, 2, 22, "8.00", "8.00", True),
    ]
    assert fx.rows(done.customers, "customer_id", "ct_consign_id") == [(51, 1)]
    assert fx.rows(done.moves, "order_id", "new_customer_id") == [(1, 51), (6, 51)]
    assert fx.rows(done.rejected, "order_id", "reason") == [
        (3, "does not have a credit balance"), (4, "Please enter store credit customer"), (5, "does not have a credit balance")
    ]
