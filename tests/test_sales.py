"""Orders, pricing, payments and checks on hand-computed tables."""

import datetime as dt

import fixtures as fx
import pytest
from fixtures import D
from pyspark.sql import functions as F

from shelfbook.operators import checks, payments, sales
from shelfbook.plans import inputs

METHODS = (
    "payment_method_id bigint, name string, cash boolean, till_method boolean, store_credit boolean, gift_card boolean"
)


@pytest.fixture(scope="module")
def methods(spark):
    return spark.createDataFrame(
        [(1, "Cash", True, True, None, None), (2, "Card", None, None, None, None), (3, "Store", None, None, True, None),
         (4, "Gift", None, None, None, True), (5, "Check", None, True, None, None)],
        METHODS,
    )


def paid(spark, *rows):
    return spark.createDataFrame(
        [(i, o, m, D(a), c, g) for i, o, m, a, c, g in rows],
        "order_payment_id bigint, order_id bigint, payment_method_id bigint, amount decimal(20,2), "
        "customer_payment_id bigint, gift_card_id bigint",
    )


def test_discount_and_its_removal(spark):
    lines = fx.lines(spark, fx.line(1, 1, "item", 1, None, 1, "9.99"), fx.line(1, 2, "gift_card", None, None, 1, "10.00"), fx.line(2, 1, "item", 1, None, 1, "9.99"))
    requests = spark.createDataFrame([(1, 15)], "order_id bigint, percent int")
    cut = sales.apply_order_discount(lines, requests)
    assert fx.rows(cut, "order_id", "line_number", "unit_price", "discounted") == [
        (1, 1, "8.49", True), (1, 2, "10.00", None), (2, 1, "9.99", None)
    ]
    orders = spark.createDataFrame([(1, None, 15), (2, None, None)], "order_id bigint, close_ts timestamp_ntz, discount int")
    back = sales.remove_order_discount(cut.withColumn("unit_price", F.col("unit_price").cast("decimal(10,2)")), orders)
    assert fx.rows(back, "order_id", "line_number", "unit_price", "discounted") == [
        (1, 1, "9.99", None), (1, 2, "10.00", None), (2, 1, "9.99", None)
    ]


@pytest.mark.parametrize("percent", [0, 1, 33, 50, 85, 99])
def test_undoing_a_discount_stays_within_the_rounding_bound(spark, percent):
    prices = spark.range(1, 400).select(F.lit(1).cast("bigint").alias("order_id"), F.lit(1).alias("line_number"),
        F.col("id").alias("item_id"), (F.col("id") * F.lit(D("0.37"))).cast("decimal(10,2)").alias("unit_price"), F.lit(None).cast("boolean").alias("discounted"))
    cut = sales.apply_order_discount(prices, spark.createDataFrame([(1, percent)], "order_id bigint, percent int"))
    back = sales.remove_order_discount(
        cut.withColumn("unit_price", F.col("unit_price").cast("decimal(10,2)")),
        spark.createDataFrame([(1, None, percent)], "order_id bigint, close_ts timestamp_ntz, discount int"),
    )
    off = back.select("item_id", F.col("unit_price").alias("b")).join(prices, "item_id").agg(F.max(F.abs(F.col("b") - F.col("unit_price")))).first()[0]
    bound = D("0.005") / (1 - D(percent) / 100) + D("0.005")
    assert off <= bound


def test_single_line_discount_needs_the_right_mark(spark):
    lines = fx.lines(
        spark, fx.line(1, 1, "item", 1, None, 1, "10.00"), fx.line(1, 2, "item", 1, None, 1, "10.00", discounted=True),
        fx.line(1, 3, "item", 1, None, 1, "8.00", discounted=True), fx.line(1, 4, "item", 1, None, 1, "8.00"), fx.line(2, 1, "item", 1, None, 1, "10.00"),
    )
    orders = spark.createDataFrame([(1, None, 20), (2, dt.datetime(2013, 1, 1), 20)], "order_id bigint, close_ts timestamp_ntz, discount int")
    flag = F.when(F.col("line_number") <= 2, "add").otherwise("remove")
    got = fx.rows(sales.toggle_line_discount(lines, orders, flag), "order_id", "line_number", "unit_price", "discounted")
    assert got == [(1, 1, "8.00", True), (1, 2, "10.00", True), (1, 3, "10.00", None), (1, 4, "8.00", None), (2, 1, "10.00", None)]


def test_zero_price_and_quantity_count_as_missing(spark):
    entered = spark.createDataFrame(
        [(1, 1, 5, D("0.00"), 0), (1, 2, 5, None, None), (1, 3, 5, D("3.00"), 2), (1, 4, 6, None, 1), (1, 5, 99, D("1.00"), 1), (2, 1, 5, D("10.00"), 1)],
        "order_id bigint, line_number int, item_id bigint, unit_price decimal(10,2), qty int",
    )
    items = spark.createDataFrame([(5, D("7.50")), (6, None)], "item_id bigint, unit_price decimal(10,2)")
    orders = spark.createDataFrame([(1, None), (2, 25)], "order_id bigint, discount int")
    got = fx.rows(sales.price_sale_lines(entered, items, orders), "order_id", "line_number", "qty", "unit_price", "discounted")
    assert got == [(1, 1, 1, "7.50", None), (1, 2, 1, "7.50", None), (1, 3, 2, "3.00", None), (1, 4, 1, "0.00", None), (2, 1, 1, "7.50", True)]
    assert fx.rows(sales.reject_invalid_items(entered, items), "line_number", "item_id") == [(5, 99)]


def test_grand_total_row(spark):
    df = spark.createDataFrame([("A", D("1.10")), ("B", D("2.20"))], "name string, amount decimal(20,2)")
    assert fx.rows(sales.with_grand_total(df, ["name"], ["amount"])) == [("A", "1.10", False), ("B", "2.20", False), (None, "3.30", True)]
    unnamed = spark.createDataFrame([(None, D("1.10"))], "name string, amount decimal(20,2)")
    assert fx.rows(sales.with_grand_total(unnamed, ["name"], ["amount"])) == [(None, "1.10", False), (None, "1.10", True)]
    assert fx.rows(sales.with_grand_total(df.filter("false"), ["name"], ["amount"])) == [(None, None, True)]


def test_change_is_taken_off_the_payment(spark):
    due = spark.createDataFrame([(1, D("7.50")), (2, D("7.50")), (3, D("7.50"))], "order_id bigint, balance_due decimal(20,2)")
    tenders = spark.createDataFrame([(1, D("10.00")), (2, D("7.50")), (3, D("5.00"))], "order_id bigint, tendered decimal(20,2)")
    assert fx.rows(payments.cash_change(tenders, due)) == [(1, "7.50", "2.50"), (2, "7.50", None), (3, "5.00", None)]


def test_merging_leaves_till_and_processed_payments_alone(spark, methods):
    rows = paid(
        spark, (1, 9, 2, "1.00", None, None), (2, 9, 2, "2.00", None, None), (3, 9, 2, "4.00", 70, None), (4, 9, 1, "8.00", None, None),
        (5, 9, 1, "8.00", None, None), (6, 9, 4, "3.00", None, 33), (7, 8, 4, "3.00", None, 33), (8, 8, 4, "3.00", None, 44),
    )
    merged = payments.merge_duplicate_payments(rows, methods)
    assert fx.rows(merged, "order_id", "payment_method_id", "amount", "idcount") == [(8, 4, "6.00", 2), (9, 2, "3.00", 2)]
    replaced = payments.merged_payment_ids(rows, methods)
    assert fx.rows(replaced) == [(8, 4, 7), (8, 4, 8), (9, 2, 1), (9, 2, 2)]
    after = fx.rows(payments.payments_after_merge(rows, methods), "order_payment_id", "amount", "gift_card_id")
    assert after == [(1, "3.00", None), (3, "4.00", None), (4, "8.00", None), (5, "8.00", None), (6, "3.00", 33), (7, "6.00", None)]


def test_worklist_flags(spark):
    columns = ("order_id bigint, customer_id bigint, order_balance decimal(20,2), gl_credit_balance decimal(20,2), "
               "order_status string, discount int, has_lines boolean, has_payments boolean")
    positions = spark.createDataFrame(
        [(1, 7, D("5.00"), D("-1.00"), "pos", None, True, False), (2, 1, D("0.00"), D("-1.00"), "pos", 10, True, True),
         (3, 7, D("0.00"), D("0.00"), "pos", 0, False, False), (4, 7, D("5.00"), D("0.00"), "closed", None, True, False)],
        columns,
    )
    walk_in = spark.createDataFrame([(1,)], "customer_id bigint")
    got = fx.rows(sales.order_worklist(positions, walk_in), "order_id", "can_pay", "can_close", "can_discount", "owes_account", "can_apply_gift")
    assert got == [(1, True, False, True, True, False), (2, False, True, False, False, False), (3, False, False, False, False, True)]


def test_walk_in_orders_keep_their_store_credit(spark, methods):
    rows = paid(spark, (1, 1, 3, "1.00", None, None), (2, 2, 3, "1.00", None, None), (3, 3, 3, "1.00", None, None), (4, 2, 2, "1.00", None, None))
    orders = spark.createDataFrame([(1, 1), (2, 7), (3, 7)], "order_id bigint, customer_id bigint")
    moves = spark.createDataFrame([(1, 8), (2, 8), (3, 7)], "order_id bigint, new_customer_id bigint")
    walk_in = spark.createDataFrame([(1,)], "customer_id bigint")
    left = payments.payments_after_reassign(rows, orders, moves, walk_in, methods)
    assert fx.rows(left, "order_payment_id") == [(1,), (3,), (4,)]


def test_tills_without_a_balance_must_be_balanced_first(spark, methods):
    tills = spark.createDataFrame(
        [(1, 5, dt.datetime(2013, 1, 1), D("10.00")), (2, 5, dt.datetime(2013, 1, 2), D("20.00")), (3, 5, dt.datetime(2013, 1, 2), D("30.00"))],
        "till_transaction_id bigint, location_id bigint, created_ts timestamp_ntz, cash_balance decimal(20,2)",
    )
    places = spark.createDataFrame([(5,), (6,)], "location_id bigint")
    got = fx.rows(payments.latest_till(tills, places), "location_id", "till_transaction_id", "cash_balance", "must_balance_first")
    assert got == [(5, 3, "30.00", False), (6, None, None, True)]


def test_check_void_rules(spark):
    held = spark.createDataFrame(
        [(1, 501, 101, D("5.00"), True), (2, 502, 101, D("6.00"), None), (3, 503, 101, D("7.00"), False), (4, 504, 101, D("8.00"), None)],
        "check_id bigint, check_num bigint, vendor_id bigint, amount decimal(20,2), cleared boolean",
    ).selectExpr("*", "'bank' AS account", "false AS closed", "CAST(NULL AS timestamp_ntz) AS void_ts", "CAST(NULL AS bigint) AS void_check_num", "date'2013-01-01' AS check_date")
    trans = spark.createDataFrame(
        [(11, "check", 1, dt.date(2013, 1, 1)), (13, "check", 3, None), (14, "check", 4, dt.date(2013, 1, 1)), (15, "check", 4, dt.date(2013, 9, 1)), (16, "invoice", 2, None)],
        "trans_id bigint, ref string, ref_id bigint, post_date date",
    )
    status = checks.check_void_status(held, trans, dt.date(2013, 6, 30))
    assert fx.rows(status, "check_id", "status", "period_closed") == [
        (1, "cleared", True), (2, "not posted", None), (3, "voidable", False), (4, "voidable", True)
    ]
    entries = fx.rows(checks.void_check_entries(status), "trans_ref_id", "account", "debit", "credit", "memo")
    assert entries == fx.rows_like(
        (3, "bank", "7.00", "0.00", None), (3, "cogs", "0.00", "7.00", "void check"),
        (4, "bank", "8.00", "0.00", None), (4, "cogs", "0.00", "8.00", "void check"),
    )
    state = checks.void_check_state(status, F.lit("2014-01-01").cast("timestamp_ntz"))
    assert fx.rows(state, "check_id", "check_num", "void_check_num", "closed", "cleared") == [
        (1, 501, None, False, True), (2, 502, None, False, None), (3, None, 503, True, None), (4, None, 504, True, None)
    ]
    owners = fx.consignors(spark, (1, True, 101, None, "0.5", None))
    listed = checks.open_checks(held, trans, owners)
    assert fx.rows(listed, "check_id", "n_transactions") == [(2, 0), (4, 2)]
    assert fx.rows(checks.open_check_transactions(held, trans, owners)) == [(4, 14), (4, 15)]


def test_only_the_lines_of_reported_orders_are_summed(shop):
    for report in (sales.open_orders(shop.orders, shop.lines), sales.closed_orders_on(shop.orders, shop.lines, inputs.ORDER_DAY)):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan.split("Aggregate", 1)[1]


def test_orders_move_only_with_voided_checks_and_also_to_new_customers(spark):
    voidable = spark.createDataFrame(
        [(1, 7, "voidable"), (2, 7, "cleared"), (3, 8, "voidable"), (4, 7, "voidable")], "check_id bigint, vendor_id bigint, status string"
    ).selectExpr("*", "cast(5 as decimal(20,2)) as amount")
    people = fx.consignors(spark, (1, True, 7, None, "0.5", None), (2, True, 8, 30, "0.5", None))
    customers = spark.createDataFrame([(30,)], "customer_id bigint")
    vouchers = spark.createDataFrame([], "voucher_id bigint, check_id bigint")
    made = checks.check_to_store_credit(voidable, people, customers, vouchers, vouchers, vouchers)
    orders = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 99)], "order_id bigint, customer_id bigint")
    walk_in = spark.createDataFrame([(1,)], "customer_id bigint")
    moved = checks.orders_after_check(orders, walk_in, inputs.check_moves(made.owners))
    assert fx.rows(moved, "order_id", "customer_id") == [(1, 31), (2, 1), (3, 30), (4, 99)]
