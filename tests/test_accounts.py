"""Account creation, imports, text helpers and repair jobs."""

import datetime as dt

import fixtures as fx
import pytest
from fixtures import D
from pyspark.sql import functions as F

from shelfbook.functions.text import legal_name, search_consignors, search_json
from shelfbook.operators import accounts, imports, repairs
from shelfbook.sources import files


@pytest.mark.parametrize(
    ("name", "expected"),
    [("Doe, Jane", "Jane Doe"), ("Doe,Jane", "Jane Doe"), ("Doe, Jr, Jane", "Jane Doe, Jr"), ("Plain", None), ("Doe,", None), (",x", None), (None, None)],
)
def test_legal_name(spark, name, expected):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(legal_name(F.col("name"))).first()[0] == expected


def test_search_by_id_pattern_and_json(spark):
    people = spark.createDataFrame(
        [(7, 'Ann "A" Lee', 1, 2), (71, "ann b", 3, 4), (8, "Bo", 5, 6)], "ct_consign_id bigint, name string, customer_id bigint, vendor_id bigint"
    )
    assert fx.rows(search_consignors(people, "7"), "ct_consign_id") == [(7,)]
    assert fx.rows(search_consignors(people, "ANN|bo$"), "ct_consign_id") == [(7,), (71,), (8,)]
    assert fx.rows(search_json(people, "lee"), "json") == [('{"ct_consign_id":"7","name":"Ann A Lee"}',)]


def test_new_accounts_are_checked_and_numbered(spark):
    requests = spark.createDataFrame(
        [(1, None, "Doe, Jane", True, D("0.4"), D("5.00")), (2, None, "Bo", False, D("0.4"), D("5.00")), (3, 50, "Cy", True, D("0.3"), None),
         (4, None, "", None, D("0"), None), (5, None, "0", True, D("0"), D("2.00"))],
        "request_id bigint, ct_consign_id bigint, name string, cash boolean, consign_percent decimal(5,4), consign_fee decimal(10,2)",
    )
    checked = fx.rows(accounts.validate_new_accounts(requests), "request_id", "consign_percent", "consign_fee", "missing")
    assert checked == [
        (1, "0.0000", "5.00", ""), (2, "0.4000", None, ""), (3, "0.3000", None, ""),
        (4, "0.0000", None, "name, account type, percent or fee"), (5, "0.0000", "2.00", "name"),
    ]
    existing = accounts.Accounts(
        spark.createDataFrame([(9,)], "ct_consign_id bigint"), None,
        spark.createDataFrame([(100,)], "vendor_id bigint"), spark.createDataFrame([(10,)], "customer_id bigint"),
    )
    made = accounts.create_accounts(requests, existing)
    assert fx.rows(made.consignors, "request_id", "ct_consign_id", "item_id", "vendor_id", "customer_id") == [
        (1, 51, 51, 102, None), (2, 52, 52, None, 11), (3, 50, 50, 101, None)
    ]
    assert fx.rows(made.vendors, "vendor_id", "account", "legal_name") == [(101, "50", None), (102, "51", "Jane Doe")]


def test_backfill_changes_nothing_the_second_time(spark):
    people = fx.consignors(spark, (1, True, 101, None, "0.5", None), (2, True, 102, 5, "0.5", None), (3, False, None, None, "0.5", None))
    customers = spark.createDataFrame([(40,)], "customer_id bigint")
    once = accounts.backfill_customers(people, customers)
    assert fx.rows(once, "ct_consign_id", "customer_id") == [(1, 41), (2, 5), (3, None)]
    assert fx.rows(accounts.backfill_customers(once, customers)) == fx.rows(once)


def test_import_types_and_key_fixes(spark):
    staged = spark.createDataFrame([(1, "a", "CA", D("33.33")), (2, "b", "XX", D("5")), (3, "c", None, D("100"))], "ct_id bigint, name string, ctype string, cper decimal(6,2)")
    assert fx.rows(accounts.import_consignors(staged)) == [(1, "a", True, "0.3333"), (2, "b", False, "0.0500"), (3, "c", False, "1.0000")]
    fixes = spark.createDataFrame([("b", 77)], "name string, new_id bigint")
    assert fx.rows(accounts.patch_keys(staged, fixes), "ct_id", "name") == [(1, "a"), (3, "c"), (77, "b")]


def test_sales_import_skips_empty_rows(spark):
    orders = spark.createDataFrame([("jan", 1, 5, "pos", "import"), ("feb", 2, 5, "pos", "import"), ("mar", 3, 5, "order", "closed")],
        "batch string, order_id bigint, location_id bigint, order_type string, order_status string")
    shipping = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "order_id bigint, ship_id bigint")
    sold = spark.createDataFrame([("jan", 7, D("1.00")), ("jan", 8, D("0.00")), ("feb", 7, D("-2.00")), ("mar", 7, D("9.00"))], "batch string, ct_consign_id bigint, amount decimal(10,2)")
    got = fx.rows(imports.import_sales_lines(orders, shipping, sold), "order_id", "ship_id", "item_id", "unit_price")
    assert got == [(1, 11, 7, "1.00"), (2, 12, 7, "-2.00")]


def test_unknown_names_do_not_drift(spark):
    people = spark.createDataFrame([(1, "A", 101, 11), (2, "B", 102, 12), (3, None, 103, None)], "ct_consign_id bigint, name string, vendor_id bigint, customer_id bigint")
    vendors = spark.createDataFrame([(101, "A"), (102, None), (103, "C")], "vendor_id bigint, name string")
    customers = spark.createDataFrame([(11, "Z"), (12, "B")], "customer_id bigint, company string")
    drift = repairs.name_drift(people, vendors, customers)
    assert fx.rows(drift) == [("customer", 11, "Z", "A")]
    assert fx.rows(repairs.apply_names(customers, drift, "customer", "customer_id", "company")) == [(11, "A"), (12, "B")]


def test_change_log_counts_unknown_as_blank(spark):
    before = fx.consignors(spark, (1, True, None, None, "0.5", None), (2, True, None, None, "0.5", "1.00"))
    after = fx.consignors(spark, (1, False, None, None, "0.5", "2.00"), (2, True, None, None, "0.5", "1.00"))
    assert fx.rows(repairs.change_log(before, after), "field", "message") == [
        ("cash", "cash changed from true to false"), ("consign_fee", "consign_fee changed from  to 2.00")
    ]


def test_bad_discount_requests(spark):
    orders = spark.createDataFrame([(1, None, None), (2, dt.datetime(2013, 1, 1), None), (3, None, 10)], "order_id bigint, close_ts timestamp_ntz, discount int")
    asked = [(1, 1, "99"), (2, 1, "100"), (3, 1, ""), (4, 1, "1.5"), (5, 2, "10"), (6, 3, "10"), (7, 1, None), (8, 1, "0")]
    requests = spark.createDataFrame(asked, "request_id bigint, order_id bigint, percent string")
    got = dict(fx.rows(repairs.reject_invalid_discounts(requests, orders), "request_id", "reason"))
    assert set(got) == {2, 3, 4, 5, 6, 7}
    assert got[5] == "order is closed" and got[6] == "order is already discounted"


def test_gift_card_list_with_bad_rows(spark, tmp_path):
    rows = ["005\tAnn \"A\" Lee\t50\t9.99", "S001\tback\\\\slash\\tand\\ tab\t15.5\t\\N", "broken\trow", "x\ty\tmany\t1", "a\tb\t1\t2\t3", "\\."]
    (tmp_path / "cards.tsv").write_text("\n".join(rows) + "\n")
    good = fx.rows(files.load_gift_cards(spark, str(tmp_path / "cards.tsv")))
    assert good == [("005", 'Ann "A" Lee', "50.00", "9.99"), ("S001", "back\\slash\tand tab", "15.50", None)]
    bad = fx.rows(files.rejected_gift_cards(spark, str(tmp_path / "cards.tsv")))
    assert bad == [("a\tb\t1\t2\t3",), ("broken\trow",), ("x\ty\tmany\t1",)]


def test_gift_card_list_round_trip(spark, tmp_path):
    cards = spark.createDataFrame([("007", "a\tb\\n\nc", D("1.00"), None), (None, "", D("2.00"), D("0.50"))],
        "legacy_code string, name string, amount decimal(10,2), balance decimal(10,2)")
    files.save_gift_cards(cards, str(tmp_path / "out"))
    assert fx.rows(files.load_gift_cards(spark, str(tmp_path / "out"))) == fx.rows(cards)


def test_ledger_overwrite_replaces_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = fx.postings(spark, (1, dt.date(2013, 1, 1), "vendor", 1, "cc", "0", "1"), (2, dt.date(2013, 1, 2), "vendor", 1, "cc", "0", "2"), (3, None, "vendor", 1, "cc", "0", "3"))
    files.write_ledger(first, path)
    files.write_ledger(fx.postings(spark, (4, dt.date(2013, 1, 2), "vendor", 1, "cc", "0", "4")), path, mode="overwrite")
    assert fx.rows(files.read_ledger(spark, path), "trans_id", "post_date") == [(1, dt.date(2013, 1, 1)), (3, None), (4, dt.date(2013, 1, 2))]


def test_balances_from_the_stored_ledger_read_only_their_dates_and_accounts(spark, shop, tmp_path):
    from shelfbook.operators import balances, payouts
    from shelfbook.sources.shop import StoredLedgerShop

    month = shop.postings.filter("post_date IS NULL OR post_date BETWEEN '1998-12-01' AND '1999-01-31'")
    files.write_ledger(month, str(tmp_path / "ledger"))
    stored = StoredLedgerShop(spark, shop.sf_dir, str(tmp_path / "ledger"))
    assert fx.rows(balances.account_list(stored.consignors, stored.postings)) == fx.rows(balances.account_list(shop.consignors, month))
    report = payouts.payout_candidates(stored.postings, shop.vendors, shop.consignors, "100.00", dt.date(1999, 1, 1))
    text = spark._jvm.PythonSQLUtils.explainString(report._jdf.queryExecution(), "formatted")
    scan = next(part for part in text.split("\n\n") if "Scan parquet" in part and "ledger" in part)
    assert "PartitionFilters: [isnotnull(post_date" in scan and "EqualTo(account,cc)" in scan


def test_numbered_escapes_and_the_lowest_bytes_survive_the_load(spark, tmp_path):
    cells = r"\101\x42c\q\\n" + "\x01" + r"\303\244"
    (tmp_path / "cards.tsv").write_text("1\t" + cells + "\t2\t3\n")
    (row,) = fx.rows(files.load_gift_cards(spark, str(tmp_path / "cards.tsv")), "name")
    assert row == ("ABcq\\n\x01ä",)


def test_a_repeated_write_leaves_the_ledger_as_it_is(spark, tmp_path):
    path = str(tmp_path / "ledger")
    postings = fx.postings(spark, (1, dt.date(2013, 1, 1), "vendor", 1, "cc", "0", "1"), (3, None, "vendor", 1, "cc", "0", "3"))
    files.write_ledger(postings, path)
    files.write_ledger(postings, path)
    assert fx.rows(files.read_ledger(spark, path), "trans_id", "post_date") == [(1, dt.date(2013, 1, 1)), (3, None)]


def test_accounts_with_taken_ids_are_refused(spark):
    requests = spark.createDataFrame(
        [(1, 9, "A", True), (2, 50, "B", True), (3, 50, "C", True), (4, None, "D", True)],
        "request_id bigint, ct_consign_id bigint, name string, cash boolean",
    ).selectExpr("*", "cast(0.4 as decimal(5,4)) as consign_percent", "cast(null as decimal(10,2)) as consign_fee")
    existing = accounts.Accounts(
        spark.createDataFrame([(9,)], "ct_consign_id bigint"), None,
        spark.createDataFrame([(100,)], "vendor_id bigint"), spark.createDataFrame([(10,)], "customer_id bigint"),
    )
    assert fx.rows(accounts.taken_ids(requests, existing), "request_id", "reason") == [(1, "id exists"), (3, "id asked for twice")]
    assert fx.rows(accounts.create_accounts(requests, existing).consignors, "request_id", "ct_consign_id") == [(2, 50), (4, 51)]
