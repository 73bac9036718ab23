"""Multi-step jobs and session helpers."""

import fixtures as fx
from fixtures import D
from pyspark.sql import functions as F

from shelfbook import session
from shelfbook.operators import ledger, payments
from shelfbook.plans import inputs, journeys


def test_closing_sales_leaves_a_sound_ledger(spark, shop):
    ready = inputs.till_orders(shop)
    latest = payments.latest_till(shop.tills, shop.locations).filter(~F.col("must_balance_first"))
    closed = journeys.close_sales(
        ready, shop.orders, shop.lines, shop.order_payments, shop.customer_payments, shop.invoices, shop.consignors,
        shop.methods, latest, inputs.now(),
    )
    assert closed.postings.count() > 0
    assert ledger.ledger_balance_check(closed.postings, ["trans_ref", "trans_ref_id"]).count() == 0
    assert closed.orders.filter("order_status <> 'closed' OR close_ts IS NULL").count() == 0
    assert closed.invoices.count() == ready.count() == closed.invoices.select("invoice_id").distinct().count()
    assert closed.invoices.join(shop.invoices, "invoice_id", "left_semi").count() == 0
    assert closed.lines.filter("invoice_id IS NULL OR account <> 'sales'").count() == 0
    # Every processed payment is allocated once, and amounts are kept by merging.
    paid = closed.payments.agg(F.sum("amount")).first()[0]
    assert closed.allocations.agg(F.sum("amount")).first()[0] == paid
    open_payments = shop.order_payments.filter("customer_payment_id IS NULL").join(ready, "order_id", "left_semi")
    assert open_payments.agg(F.sum("amount")).first()[0] == paid


def test_vendor_payments_balance_and_agree_with_their_candidates(shop):
    run = journeys.pay_vendors(
        shop.postings, shop.vendors, shop.consignors, inputs.PAYOUT_MINIMUM, inputs.PAY_DATE, inputs.RUN_DATE
    )
    assert run.candidates.count() == run.headers.count() > 0
    assert ledger.ledger_balance_check(run.entries, ["ref_num"]).count() == 0
    assert run.lines.agg(F.sum("unit_cost")).first()[0] == run.candidates.agg(F.sum("amount")).first()[0]


def test_cc_balances_add_up_to_all_cc_postings(shop):
    from shelfbook.operators import balances

    cc = shop.postings.filter("account = 'cc' AND post_date IS NOT NULL")
    whole = cc.filter("ref IN ('vendor', 'customer')").agg(F.sum(F.col("credit") - F.col("debit"))).first()[0]
    parts = [balances.vendor_cash_balance(shop.postings), balances.customer_credit_balance(shop.postings)]
    assert sum(p.agg(F.sum("balance")).first()[0] for p in parts) == whole


def test_shuffles_are_sized_by_the_input(spark, tmp_path, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(1000).write.parquet(str(tmp_path / "in"))
    session.size_shuffles(spark, str(tmp_path / "in"))
    assert spark.conf.get(key, None) is None
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 100)
    spark.range(1000).write.parquet(str(tmp_path / "more"))
    session.size_shuffles(spark, str(tmp_path / "more"))
    try:
        assert int(spark.conf.get(key)) > 8
    finally:
        spark.conf.unset(key)


def test_one_employee_sees_the_methods_of_their_groups(spark):
    groups = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "employee_id bigint, group_id bigint")
    usable = spark.createDataFrame([(10, 5), (11, 5), (11, 6), (12, 7)], "group_id bigint, payment_method_id bigint")
    methods = spark.createDataFrame([(5, "b"), (6, "a"), (7, "c")], "payment_method_id bigint, name string")
    got = payments.allowed_payment_methods(groups, usable, methods, employee_id=1).collect()
    assert [r.name for r in got] == ["a", "b"]
    every = payments.allowed_payment_methods(groups, usable, methods)
    assert fx.rows(every, "employee_id", "payment_method_id") == [(1, 5), (1, 6), (2, 7)]


def test_cashing_a_card_needs_an_empty_order_and_a_balance(spark):
    requests = spark.createDataFrame([(1, 7, 50), (2, 7, 50), (3, 7, 51), (4, 8, 50)], "order_id bigint, ct_consign_id bigint, gift_card_id bigint")
    orders = spark.createDataFrame([(1,), (2,), (3,), (4,)], "order_id bigint")
    lines = spark.createDataFrame([(2,)], "order_id bigint")
    owners = fx.consignors(spark, (7, True, 107, 77, "0.5", None), (8, True, 108, None, "0.5", None))
    cards = spark.createDataFrame([(50, D("9.00"), True), (51, D("0.00"), False)], "gift_card_id bigint, balance decimal(20,2), available boolean")
    got = payments.cash_gift_to_account(requests, orders, lines, owners, cards, gift_method=4)
    assert fx.rows(got, "order_id", "customer_id", "item_id", "unit_price", "payment_amount") == [
        (1, 77, 7, "9.00", "9.00"), (4, None, None, "9.00", "9.00")
    ]


def test_orders_at_an_unbalanced_till_stay_open(shop):
    ready = inputs.till_orders(shop)
    latest = payments.latest_till(shop.tills, shop.locations).filter(~F.col("must_balance_first"))
    open_payments = shop.order_payments.filter("customer_payment_id IS NULL").join(ready, "order_id", "left_semi")
    rung = open_payments.filter(F.col("payment_method_id").isin(1, 5)).join(shop.orders.select("order_id", F.col("location_id").alias("at")), "order_id")
    place = rung.agg(F.min("at")).first()[0]
    closed = journeys.close_sales(
        ready, shop.orders, shop.lines, shop.order_payments, shop.customer_payments, shop.invoices, shop.consignors,
        shop.methods, latest.filter(F.col("location_id") != place), inputs.now(),
    )
    refused = {r.order_id for r in closed.rejected.collect()}
    assert {r.order_id for r in rung.filter(F.col("at") == place).collect()} <= refused
    still = {r.order_id for r in closed.orders.filter("order_status <> 'closed'").collect()}
    assert still == refused
    assert not refused & {r.order_id for r in closed.invoices.collect()}
    assert not refused & {r.order_id for r in closed.payments.collect()}
