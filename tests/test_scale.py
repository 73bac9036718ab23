"""Skewed keys, plan shapes and exactness of the distributed helpers."""

import datetime as dt
import random
import re

import fixtures as fx
import pytest
from fixtures import D
from pyspark.sql import functions as F

from shelfbook.functions import keys
from shelfbook.functions.keys import next_ids, number_rows, running_totals
from shelfbook.functions.pairing import theta_join
from shelfbook.operators import ledger, payments, repairs, sales
from shelfbook.plans.catalog import QUERIES
from shelfbook.session import tune


@pytest.fixture
def settings(spark):
    """Change session settings for one test."""
    before = {}

    def change(**values):
        for key, value in values.items():
            name = key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# Small enough that test-sized partitions count as skewed, and no join is a broadcast.
SKEWED = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "2000",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4000",
    "spark__sql__adaptive__coalescePartitions__parallelismFirst": "false",
}


def test_running_totals_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 20), rng.randrange(50), i, D(rng.randrange(-500, 500)) / 100) for i in range(5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "place bigint, at int, id bigint, amount decimal(20,2)").repartition(7)
    got = {r.id: r.sofar for r in running_totals(df, ["at", "id"], {"sofar": "amount"}, ["place"]).collect()}
    expected, sofar = {}, {}
    for place, _, key, amount in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        sofar[place] = sofar.get(place, D("0.00")) + amount
        expected[key] = sofar[place]
    assert got == expected


def test_a_hot_group_is_cut_into_slices(spark, settings):
    settings(spark__sql__adaptive__enabled="false")
    df = spark.range(20000).select(F.lit(1).alias("place"), "id", F.lit(1).alias("n"))
    plan = running_totals(df, ["id"], {"total": "n"}, ["place"])._jdf.queryExecution().executedPlan().toString()
    # Every window over the rows is partitioned by the slice first.
    assert re.search(r"windowspecdefinition\(_slice", plan)
    assert running_totals(df, ["id"], {"total": "n"}, ["place"]).agg(F.max("total")).first()[0] == 20000


def test_ids_are_consecutive_and_follow_the_order(spark):
    new = spark.range(3000).select((F.col("id") * 7 % 3001).alias("k")).repartition(5)
    got = next_ids(spark.createDataFrame([(10,), (4,)], "key bigint"), "key", new, ["k"], "key")
    assert [r.key for r in got.orderBy("k").collect()] == list(range(11, 3011))
    empty = next_ids(spark.createDataFrame([], "key bigint"), "key", new.limit(1), ["k"], "key")
    assert empty.first().key == 1
    assert number_rows(new.filter("false"), ["k"], "n").count() == 0


def test_a_key_with_many_ids_is_one_header_and_all_its_links(spark):
    methods = spark.createDataFrame([(2, None)], "payment_method_id bigint, till_method string")
    rows = spark.range(25_000).select(
        F.col("id").alias("order_payment_id"), F.lit(9).cast("bigint").alias("order_id"), F.lit(2).cast("bigint").alias("payment_method_id"),
        F.lit("1.00").cast("decimal(20,2)").alias("amount"), F.lit(None).cast("bigint").alias("customer_payment_id"),
    )
    assert fx.rows(payments.merge_duplicate_payments(rows, methods)) == [(9, 2, "25000.00", 25_000)]
    assert payments.merged_payment_ids(rows, methods).select("order_payment_id").distinct().count() == 25_000


def test_repeated_requests_never_multiply_rows(spark):
    orders = spark.createDataFrame([(1, 5)], "order_id bigint, customer_id bigint")
    moves = spark.createDataFrame([(1, 8), (1, 7)], "order_id bigint, new_customer_id bigint")
    assert fx.rows(payments.reassign_customer(orders, moves)) == [(1, 7)]


def _skewed_sales(spark, hot_order, hot_item, n=120000):
    key = F.col("id")
    order = F.when(key % 3 == 0, 1).otherwise(key % 997 + 2) if hot_order else key % 997 + 2
    item = F.when(key % 3 == 1, 1).otherwise(key % 50) if hot_item else key % 50
    item = F.when(key % 10 == 0, None).otherwise(item)
    # Prices without a pattern, so that the hot rows do not compress to nothing.
    price = (F.pmod(F.xxhash64("id"), F.lit(10**7)) * F.lit(D("0.01"))).cast("decimal(10,2)")
    lines = spark.range(n).repartition(6).select(
        order.cast("bigint").alias("order_id"), order.cast("bigint").alias("invoice_id"), F.lit("sales").alias("account"),
        F.when(key % 7 == 0, "gift_card").otherwise("item").alias("item_type"), item.cast("bigint").alias("item_id"),
        F.lit(None).cast("bigint").alias("gift_card_id"), (key % 3 + 1).cast("int").alias("qty"),
        price.alias("unit_price"), (price * (key % 3 + 1)).cast("decimal(20,2)").alias("total_price"),
        (price * F.lit(D("0.07"))).cast("decimal(20,2)").alias("tax_amount"),
    )
    invoices = spark.range(1, 1000).select(key.alias("invoice_id"), key.alias("order_id"), (key % 40).alias("customer_id"), F.lit("2013-01-01").cast("timestamp_ntz").alias("created_ts"))
    owners = spark.range(50).select(
        key.alias("item_id"), (key % 3 != 0).alias("cash"), (key + 100).alias("vendor_id"), (key + 500).alias("customer_id"),
        F.lit(D("0.3333")).cast("decimal(5,4)").alias("consign_percent"), F.when(key % 10 == 0, F.lit(D("0.25"))).cast("decimal(10,2)").alias("consign_fee"),
    )
    return lines, invoices, owners


def _fingerprint(postings):
    sums = postings.groupBy("invoice_id", "ref", "account").agg(
        F.count("*").alias("n"), F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.bit_xor(F.xxhash64("ref_id", "debit", "credit")).alias("h")
    )
    return fx.rows(sums)


@pytest.mark.parametrize(("hot_order", "hot_item"), [(True, False), (False, True), (True, True)])
def test_posting_splits_a_hot_invoice_and_a_hot_consignor(spark, settings, hot_order, hot_item):
    tables = _skewed_sales(spark, hot_order, hot_item)
    expected = _fingerprint(ledger.post_invoices(*tables))
    settings(**SKEWED)
    assert _fingerprint(ledger.post_invoices(*tables)) == expected
    posted = ledger.post_invoices(*tables)
    posted.collect()
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("skew=true") == hot_order + hot_item


def test_large_inputs_need_one_shuffle_of_the_lines_per_join(spark, settings):
    """Without broadcasts, posting shuffles lines by item and by invoice, and not again to aggregate."""
    settings(**SKEWED)
    plan = ledger.post_invoices(*_skewed_sales(spark, False, False))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream_", "write_"))])
def test_plans_have_no_cross_joins_or_python(name, shop):
    plan = QUERIES[name](shop)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan


def test_day_filters_and_columns_reach_the_scan_of_stored_orders(spark, shop, tmp_path):
    shop.orders.write.parquet(str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    report = sales.sales_by_location(stored, shop.lines, shop.locations, dt.date(1998, 10, 3))
    scan = next(s for s in _scans(report) if "close_ts" in s)
    assert "GreaterThanOrEqual(close_ts" in scan and "LessThan(close_ts" in scan
    assert "customer_id" not in scan and "discount" not in scan


def _scans(df):
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [part for part in text.split("\n\n") if "Scan parquet" in part]


def test_payment_day_filter_reaches_the_scan(shop):
    scan = next(s for s in _scans(QUERIES["payments_by_class"](shop)) if "events" in s)
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan
    assert "props" not in scan


@pytest.mark.parametrize("cell", [7, 1000])
def test_theta_joins_pair_every_row_once(spark, cell):
    left = spark.range(40).select(F.col("id").alias("a")).union(spark.range(3).select(F.lit(None).cast("bigint")))
    right = spark.range(23).select((F.col("id") * 2).alias("b"))
    joined = theta_join(left, right, F.col("a") < F.col("b"), cell)
    got = sorted((r.a, r.b) for r in joined.collect())
    assert got == sorted((a, b) for a in range(40) for b in range(0, 46, 2) if a < b)
    assert theta_join(left, right.limit(0), F.col("a") < F.col("b"), cell).count() == 0
    assert theta_join(left.limit(0), right, F.col("a") < F.col("b"), cell).count() == 0


def test_newest_entries_are_cut_before_the_shuffle(spark):
    rows = [("ct_consign", 7 if i % 3 else i % 40, dt.datetime(2024, 1, 1 + i % 5), f"m{i}", i) for i in range(900)] + [("check", 7, dt.datetime(2025, 1, 1), "x", -1)]
    logs = spark.createDataFrame(rows, "ref string, ref_id bigint, created_ts timestamp_ntz, message string, entry_id bigint").repartition(6)
    got = repairs.recent_activity(logs, logs.limit(0), most=4)
    expected = {}
    for ref, key, at, _, entry in rows:
        if ref == "ct_consign":
            expected.setdefault(key, []).append((at, entry))
    assert {(r.ct_consign_id, r.place): r.entry_id for r in got.collect()} == {
        (k, n): e for k, v in expected.items() for n, (_, e) in enumerate(sorted(v, reverse=True)[:4], 1)
    }
    text = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "WindowGroupLimit" in text.split("Exchange hashpartitioning")[-1]  # below the shuffle


def test_slices_are_cut_by_rows_not_by_compressed_bytes(spark, monkeypatch):
    pinned = []
    monkeypatch.setattr(keys, "SLICE_ROWS", 1000, raising=False)
    monkeypatch.setattr(keys, "pin", lambda df, pin=keys.pin: pinned.append(pin(df)) or pinned[-1])
    got = number_rows(spark.range(20000, 0, -1), ["id"], "n")
    assert got.filter("n = id").count() == got.count() == 20000
    sizes = [r["count"] for r in pinned[-1].groupBy("_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000


def test_packed_tasks_are_bounded_and_smaller_settings_stay(spark, settings):
    name = "spark__sql__adaptive__advisoryPartitionSizeInBytes"
    settings(**{name: "64MB", "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4000"})
    tune(spark)
    assert int(spark.conf.get(name.replace("__", "."))) <= 16 << 20
    assert spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes") == "4000"
