"""Streams fed in several files and restarted, against their batch meaning."""

import datetime as dt
import random

import fixtures as fx
import pytest
from fixtures import D
from pyspark.sql import functions as F

from shelfbook.operators.payments import till_running_balance
from shelfbook.operators.repairs import propagate_name_changes
from shelfbook.streaming import streams

PAYMENTS = "customer_payment_id bigint, location_id bigint, payment_method_id bigint, amount decimal(20,2), process_ts timestamp_ntz"


def _split(df, folder, at):
    """Write the rows below and from ``at`` as two batches of files, the older first."""
    df.filter(~at).coalesce(1).write.mode("append").parquet(folder)
    df.filter(at).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def payments(shop):
    return shop.customer_payments.select([c.split()[0] for c in PAYMENTS.split(", ")])


def test_till_balance_is_carried_between_batches(spark, shop, payments, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _split(payments, source, F.col("customer_payment_id") >= 400)
    streams.till_balance(_stream(spark, source, PAYMENTS), shop.methods, shop.locations, out).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.select("batch").distinct().count() == 2
    expected = till_running_balance(payments, shop.methods, shop.locations)
    assert fx.rows(rows.drop("batch").select(*expected.columns)) == fx.rows(expected)

    # More payments arrive after a restart from the same folder.
    later = spark.createDataFrame([(9999, 0, 1, D("5.00"), dt.datetime(2024, 3, 1))], PAYMENTS)
    later.write.mode("append").parquet(source)
    streams.till_balance(_stream(spark, source, PAYMENTS), shop.methods, shop.locations, out).awaitTermination()
    last = expected.filter("location_id = 0").agg(F.max_by("cash_balance", F.struct("process_ts", "customer_payment_id"))).first()[0]
    got = spark.read.parquet(f"{out}/rows").filter("customer_payment_id = 9999").first().cash_balance
    assert got == (last if last is not None else D("100.00")) + D("5.00")


@pytest.mark.parametrize("seed", range(3))
def test_till_balance_follows_time_for_any_arrival(spark, shop, tmp_path, seed):
    """Payments dealt to files at random: after every batch the newest rows are those of the batch form."""
    r = random.Random(seed)
    when = lambda: None if r.random() < 0.03 else dt.datetime(2024, 1, r.randint(1, 6), r.randint(0, 2))
    rows = [(i, r.choice([0, 0, 0, 1, 2, 777]), r.choice([1, 1, 2, 5]), D(r.randint(-500, 900)) / 100, when()) for i in range(80)]
    r.shuffle(rows)
    source, out, arrived = str(tmp_path / "in"), str(tmp_path / "out"), []
    cuts = sorted(r.sample(range(1, 80), 3))
    for a, b in zip([0, *cuts], [*cuts, 80], strict=True):
        arrived += rows[a:b]
        spark.createDataFrame(rows[a:b], PAYMENTS).coalesce(1).write.mode("append").parquet(source)
        streams.till_balance(_stream(spark, source, PAYMENTS), shop.methods, shop.locations, out).awaitTermination()
        expected = till_running_balance(spark.createDataFrame(arrived, PAYMENTS), shop.methods, shop.locations)
        assert fx.rows(streams.till_rows(spark, out).select(*expected.columns)) == fx.rows(expected)


def test_a_late_payment_issues_only_what_it_changes(spark, shop, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda n: dt.datetime(2024, 1, n)
    files = [
        [(1, 0, 1, D("5.00"), day(1)), (2, 0, 1, D("5.00"), day(3)), (3, 0, 1, D("5.00"), day(4)), (4, 1, 1, D("1.00"), day(4))],
        [(5, 0, 1, D("10.00"), day(3)), (6, 0, 1, D("-10.00"), dt.datetime(2024, 1, 3, 12))],  # undone before the next payment
        [(7, 0, 1, D("2.00"), day(2)), (8, 0, 2, D("9.00"), day(2))],
    ]
    for rows in files:
        spark.createDataFrame(rows, PAYMENTS).coalesce(1).write.mode("append").parquet(source)
        streams.till_balance(_stream(spark, source, PAYMENTS), shop.methods, shop.locations, out).awaitTermination()
    issued = spark.read.parquet(f"{out}/rows").groupBy("batch").agg(F.sort_array(F.collect_list("customer_payment_id")).alias("ids"))
    assert {r.batch: r.ids for r in issued.collect()} == {0: [1, 2, 3, 4], 1: [5, 6], 2: [2, 3, 5, 6, 7]}
    assert fx.rows(streams.till_rows(spark, out), "customer_payment_id", "cash_balance") == [
        (1, "105.00"), (2, "112.00"), (3, "117.00"), (4, "101.00"), (5, "122.00"), (6, "112.00"), (7, "107.00")
    ]


def test_daily_payments_add_up_over_batches(spark, shop, payments, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _split(payments, source, F.col("process_ts") >= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    stream = streams.daily_payments(_stream(spark, source, PAYMENTS), shop.methods)
    streams.run(stream, out, streams.keep_batches(out), mode="update").awaitTermination()
    got = streams.latest_rows(spark, out, ["day", "type"], streams.DAILY)
    kinds = F.when(F.col("payment_method_id").isin(3, 4), "Credit/Gift").otherwise("Cash/Check/CC")
    expected = payments.groupBy(F.to_date("process_ts").alias("day"), kinds.alias("type")).agg(F.sum("amount").cast("decimal(20,2)").alias("total"))
    assert fx.rows(got) == fx.rows(expected)


def test_late_payments_count(spark, shop, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    def arrive(key, when):
        spark.createDataFrame([(key, 0, 1, D("1.00"), when)], PAYMENTS).coalesce(1).write.mode("append").parquet(source)
        stream = streams.daily_payments(_stream(spark, source, PAYMENTS), shop.methods)
        streams.run(stream, out, streams.keep_batches(out), mode="update").awaitTermination()

    arrive(1, dt.datetime(2024, 1, 10))
    arrive(2, dt.datetime(2024, 1, 20))
    arrive(3, dt.datetime(2024, 1, 10))  # ten days late
    got = fx.rows(streams.latest_rows(spark, out, ["day", "type"], streams.DAILY), "day", "total")
    assert got == [(dt.date(2024, 1, 10), "2.00"), (dt.date(2024, 1, 20), "1.00")]


def test_daily_sums_keep_no_state_and_count_late_money(spark, shop, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    r, arrived = random.Random(5), []
    place = streams.Folder(spark, out)
    for i in range(7):
        rows = [(10 * i + k, 0, r.choice([1, 2, 3, 4]), D(r.randint(-300, 900)) / 100, dt.datetime(2024, 1, r.randint(1, 4))) for k in range(6)]
        arrived += rows
        spark.createDataFrame(rows, PAYMENTS).coalesce(1).write.mode("append").parquet(source)
        if i == 2:  # the third batch is put together, then dies before it counts as done
            with monkeypatch.context() as patch:
                patch.setattr(streams.Folder, "delete", lambda *_: 1 / 0)
                with pytest.raises(Exception):  # noqa: B017
                    streams.daily_sums(_stream(spark, source, PAYMENTS), shop.methods, out, fold=3).awaitTermination()
        streams.daily_sums(_stream(spark, source, PAYMENTS), shop.methods, out, fold=3).awaitTermination()
        whole = streams.daily_payments(spark.createDataFrame(arrived, PAYMENTS), shop.methods)
        assert fx.rows(streams.daily_sums_rows(spark, out)) == fx.rows(whole)
        assert len(place.names("base")) <= 1 and len([n for n in place.names("days") if n.startswith("batch=")]) <= 2
    assert streams.daily_sums_rows(spark, str(tmp_path / "none")).count() == 0


def test_name_sync_keeps_the_latest_name(spark, tmp_path):
    schema = "ct_consign_id bigint, name string, vendor_id bigint, customer_id bigint"
    before = spark.createDataFrame([(1, "A", 101, 11), (2, "B", None, 12)], schema)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for edits in ([(1, "A1", 101, 11), (2, "B", None, 12)], [(1, "A2", 101, 11)]):
        spark.createDataFrame(edits, schema).coalesce(1).write.mode("append").parquet(source)
        streams.name_sync(_stream(spark, source, schema), before, out).awaitTermination()
    got = fx.rows(streams.latest_rows(spark, out, ["ref", "ref_id"], streams.NAMES))
    final = spark.createDataFrame([(1, "A2", 101, 11), (2, "B", None, 12)], schema)
    assert got == fx.rows(propagate_name_changes(before, final))


def test_names_follow_every_edit_in_order(spark, tmp_path):
    schema = "ct_consign_id bigint, name string, vendor_id bigint, customer_id bigint, edit_no int"
    before = spark.createDataFrame([(1, "A", 101, None, 0), (2, "B", 102, None, 0)], schema)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, "A1", 101, None, 1), (2, "Z", 102, None, 2), (2, "B2", 102, None, 3)], [(1, "A", 101, None, 4)]]
    for edits in batches:
        spark.createDataFrame(edits, schema).coalesce(1).write.mode("append").parquet(source)
        streams.name_sync(_stream(spark, source, schema), before, out, "edit_no").awaitTermination()
    got = fx.rows(streams.latest_rows(spark, out, ["ref", "ref_id"], streams.NAMES))
    assert got == [("vendor", 101, "A"), ("vendor", 102, "B2")]


def test_names_of_many_accounts_equal_a_loop(spark, tmp_path):
    """Random edits over several batches and restarts, with unknown accounts, missing names and large ids."""
    r = random.Random(4)
    schema = "ct_consign_id bigint, name string, vendor_id bigint, customer_id bigint, edit_no int"
    big = 2**62
    before = {i: r.choice(["A", "B", None]) for i in range(6)}
    held, expected, number = dict(before), {}, 0
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.createDataFrame(list(before.items()), "ct_consign_id bigint, name string")
    for _ in range(3):
        edits = []
        for _ in range(14):
            number += 1
            i = r.choice([*range(8), None])
            edits.append((i, r.choice(["A", "B", "C", None]), None if r.random() < 0.3 else big + (i or 0), i, number))
        last = {}
        for edit in edits:
            last[edit[0]] = edit
        for i, (_, name, vendor, customer, _) in last.items():
            if i is None or name is None:
                continue
            if held.get(i) is not None and held[i] != name:
                expected |= {("customer", customer): name} | ({("vendor", vendor): name} if vendor else {})
            held[i] = name
        r.shuffle(edits)
        spark.createDataFrame(edits, schema).coalesce(1).write.mode("append").parquet(source)
        streams.name_sync(_stream(spark, source, schema), table, out, "edit_no").awaitTermination()
    got = streams.latest_rows(spark, out, ["ref", "ref_id"], streams.NAMES).collect()
    assert {(x.ref, x.ref_id): x.new_name for x in got} == expected
    assert spark.conf.get(streams.PROVIDER) != streams.ROCKS


def test_reports_read_tables_of_many_files_and_none(spark, shop, tmp_path):
    from shelfbook.plans import catalog
    from shelfbook.sources.shop import Shop

    many = str(tmp_path / "many")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        spark.read.parquet(f"{shop.sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{many}/{name}.parquet")
    for name in ("stream_daily_payments", "stream_name_sync", "stream_till_balance"):
        assert fx.rows(catalog.QUERIES[name](Shop(spark, many))) == fx.rows(catalog.QUERIES[name](shop)), name
    assert streams.latest_rows(spark, str(tmp_path / "none"), ["day", "type"], streams.DAILY).count() == 0
