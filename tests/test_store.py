"""The stored ledger under repeated, moved and interrupted writes."""

import datetime as dt
import re
import time
from collections import Counter

import pytest
from fixtures import D
from pyspark.sql import functions as F

from shelfbook import session
from shelfbook.sources import files, snapshots, swap

KIND = "trans_id bigint, trans_ref string, trans_ref_id bigint, account string, ref string, ref_id bigint, debit decimal(20,2), credit decimal(20,2), post_date date"


def day(n):
    return n if n is None else dt.date(2013, 1, n)


def book(spark, *rows):
    """Rows of (kind, document, day, amount), two postings each."""
    full = [(1, k, i, a, "vendor", 1, D(x), D(y), day(d)) for k, i, d, x in rows for a, x, y in (("cc", x, 0), ("ap", 0, x))]
    return spark.createDataFrame(full, KIND)


def held(spark, path):
    """(kind, document, day, amount) of the stored postings of one side."""
    rows = files.read_ledger(spark, path, KIND).filter("account = 'cc'").collect()
    return sorted(((r.trans_ref, r.trans_ref_id, r.post_date and r.post_date.day, int(r.debit)) for r in rows), key=str)


OLD = [("invoice", 1, 5, 10), ("invoice", 2, 5, 20), ("invoice", 3, 6, 30), ("invoice", 4, None, 40), (None, None, 7, 50)]


def test_documents_of_one_date_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(book(spark, *OLD), path)
    files.write_ledger(book(spark, ("payment", 1, 5, 7)), path)
    files.write_ledger(book(spark, *OLD[:1]), path)
    assert held(spark, path) == sorted([*OLD, ("payment", 1, 5, 7)], key=str)


def test_a_document_is_replaced_wherever_it_lies(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(book(spark, *OLD), path)
    new = [("invoice", 1, 6, 11), ("invoice", 3, None, 31), ("invoice", 4, 8, 41), (None, None, 7, 51)]
    for _ in range(2):
        files.write_ledger(book(spark, *new), path)
        assert held(spark, path) == sorted([OLD[1], *new], key=str)
    assert {n for n in swap.Folder(spark, path).names() if "=" in n} == {f"post_date={d}" for d in ("2013-01-05", "2013-01-06", "2013-01-07", "2013-01-08", files.NO_PERIOD)}
    files.write_ledger(book(spark, ("invoice", 2, 9, 21)), path)
    assert "post_date=2013-01-05" not in swap.Folder(spark, path).names()  # nothing is left of this date


def test_documents_that_stay_are_looked_for_on_their_dates_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(book(spark, *OLD), path)
    files.write_ledger(book(spark, ("invoice", 1, 5, 12)), path, anywhere=False)
    assert held(spark, path) == sorted([("invoice", 1, 5, 12), *OLD[1:]], key=str)


def test_nothing_to_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(book(spark), path)
    files.write_ledger(book(spark, *OLD), path)
    files.write_ledger(book(spark), path)
    assert held(spark, path) == sorted(OLD, key=str)


def test_more_columns_are_kept(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(book(spark, *OLD).selectExpr("*", "'old' AS memo"), path)
    files.write_ledger(book(spark, ("invoice", 9, 5, 1)).selectExpr("*", "'x' AS note"), path)
    rows = spark.read.option("mergeSchema", "true").parquet(path).collect()
    assert Counter((r.memo, r.note) for r in rows if r.post_date == day(5)) == Counter({("old", None): 4, (None, "x"): 2})


@pytest.mark.parametrize("first", [True, False])
def test_a_writer_that_dies_leaves_all_or_nothing(spark, tmp_path, monkeypatch, first):
    """Every step of the swap fails once; readers see the old or the new rows, and a repeat gives the new ones."""
    new = [("invoice", 1, 6, 11), ("invoice", 3, None, 31), ("payment", 5, 5, 1)]
    before = [] if first else OLD
    after = sorted([r for r in before if r[:2] not in {n[:2] for n in new}] + new, key=str)
    steps, at = 0, 0
    while True:
        path = str(tmp_path / f"ledger{at}")
        if before:
            files.write_ledger(book(spark, *before), path)
        count = {"n": 0}

        def dying(name, plain):
            def step(self, *args):
                count["n"] += 1
                if count["n"] == at + 1:  # noqa: B023
                    raise KeyboardInterrupt(name)
                return plain(self, *args)

            return step

        with monkeypatch.context() as patch:
            for name in ("move", "delete", "write"):
                patch.setattr(swap.Folder, name, dying(name, getattr(swap.Folder, name)))
            try:
                files.write_ledger(book(spark, *new), path)
                died = False
            except KeyboardInterrupt:
                died = True
                steps += 1
        if died and not before and not any("=" in n or n == swap.JOURNAL for n in swap.Folder(spark, path).names()):
            seen = []  # a table that was never published
        else:
            seen = held(spark, path)
        assert seen in (sorted(before, key=str), after)
        files.write_ledger(book(spark, *new), path)
        assert held(spark, path) == after
        assert not [n for n in swap.Folder(spark, path).names() if n.startswith(swap.STAGED) or n == swap.JOURNAL]
        if not died:
            break
        at += 1
    assert steps >= 5


def test_headers_are_replaced_by_document(spark, tmp_path):
    path = str(tmp_path / "headers")
    kind = "trans_id bigint, ref string, ref_id bigint, ref_date date, description string, post_date date"
    make = lambda *rows: spark.createDataFrame([(i, "invoice", i, day(d), text, day(d)) for i, d, text in rows], kind)
    files.write_transactions(make((1, 1, "a"), (2, 2, "b"), (3, None, "c")), path)
    for _ in range(2):
        files.write_transactions(make((2, 3, "B"), (3, 4, "C"), (4, 1, "d")), path)
    got = sorted((r.ref_id, r.post_date and r.post_date.day, r.description) for r in files.read_transactions(spark, path).collect())
    assert got == [(1, 1, "a"), (2, 3, "B"), (3, 4, "C"), (4, 1, "d")]


def sums(df, before=None):
    rows = df.collect()
    out = Counter()
    for r in rows:
        if before is None or (r.post_date and r.post_date < before):
            out[r.ref_id, r.account, r.post_date is None] += r.credit - r.debit
    return {k: v for k, v in out.items() if v}


DAYS = [("invoice", i, d, 10 * i) for i, d in enumerate([1, 1, 3, 5, 5, 8, 12, None], 1)]


def test_snapshots_sum_up_like_the_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(book(spark, *DAYS), path)
    ledger = files.read_ledger(spark, path, KIND)
    for as_of in (None, 5, 9, 5, 30):
        if as_of:
            files.take_snapshot(spark, path, day(as_of))
        for before in (None, 1, 2, 5, 6, 9, 13):
            got = files.read_balances(spark, path, before and day(before))
            assert sums(got, before and day(before)) == sums(ledger, before and day(before))
    assert snapshots.taken(spark, path) == [day(5), day(9), day(30)]
    near = files.read_balances(spark, path, day(13))
    read = {r.n.split("/")[-2] for r in near.select(F.input_file_name().alias("n")).distinct().collect()}
    assert read == {"as_of=2013-01-09", "post_date=2013-01-12"}  # one snapshot and the days behind it


def test_a_write_takes_away_the_snapshots_it_would_make_stale(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(book(spark, *DAYS), path)
    for as_of in (2, 4, 9):
        files.take_snapshot(spark, path, day(as_of))
    files.write_ledger(book(spark, ("invoice", 50, None, 1)), path)  # an open one is in no snapshot
    assert snapshots.taken(spark, path) == [day(2), day(4), day(9)]
    files.write_ledger(book(spark, ("invoice", 51, 20, 1)), path)
    assert snapshots.taken(spark, path) == [day(2), day(4), day(9)]
    files.write_ledger(book(spark, ("invoice", 4, 20, 41)), path)  # lay on the fifth
    assert snapshots.taken(spark, path) == [day(2), day(4)]
    files.write_ledger(book(spark, ("payment", 1, 3, 2)), path, mode="append")
    assert snapshots.taken(spark, path) == [day(2)]
    ledger = files.read_ledger(spark, path, KIND)
    files.take_snapshot(spark, path, day(15))
    assert sums(files.read_balances(spark, path, day(21)), day(21)) == sums(ledger, day(21))


def test_a_dying_writer_leaves_no_stale_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    files.write_ledger(book(spark, *DAYS), path)
    files.take_snapshot(spark, path, day(9))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(swap, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            files.write_ledger(book(spark, ("invoice", 1, 1, 11)), path)
    assert snapshots.taken(spark, path) == []
    files.write_ledger(book(spark, ("invoice", 1, 1, 11)), path)
    assert sums(files.read_balances(spark, path)) == sums(files.read_ledger(spark, path, KIND))


def test_names_between_the_ends_may_be_of_a_document(spark):
    kind = "trans_ref string, trans_ref_id bigint"
    stored = spark.createDataFrame([("a", 1), ("b", 5), ("b", None), (None, 5), ("c", 5)], kind)
    wanted = [("a", 5), ("b", 4)], [("b", 5), ("b", None)], [(None, None)]
    keys = ["trans_ref", "trans_ref_id"]
    found = [stored.filter(files._between(spark.createDataFrame(w, kind), keys)).collect() for w in wanted]
    assert [sorted(map(tuple, f), key=str) for f in found] == [[("b", 5)], [("b", 5), ("b", None)], []]


def test_a_document_moves_between_a_date_and_none(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for day in (5, None, 6, None):
        files.write_ledger(book(spark, ("invoice", 2, day, 20), ("invoice", 3, 5, 1)), path)
        days = [r.post_date and r.post_date.day for r in files.read_ledger(spark, path).filter("trans_ref_id = 2").collect()]
        assert set(days) == {day}


def test_a_write_goes_in_portions_and_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    """Busy dates are split by document, small ones packed; neither pinned rows nor shuffled ones stay when a write has ended."""
    shared, path = tmp_path / "shared", str(tmp_path / "ledger")
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(shared))
    monkeypatch.setattr(files, "PORTION_ROWS", 100, raising=False)
    sizes, plain = [], files._write_by

    def counted(period, df, *args, **more):
        with session.settings(spark, session.FREED):
            sizes.append(df.count())
        plain(period, df, *args, **more)

    monkeypatch.setattr(files, "_write_by", counted)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(re.findall(r"shuffle_\d+_\d+", disk.getAllBlocks().mkString(" ")))
    old = [("invoice", i, None if i % 11 == 0 else 5 if i < 100 else 6 + i % 9, i) for i in range(150)]
    paid = [("payment", i, 5 + i % 3, i) for i in range(30)]
    new = [(k, i, 20 if i % 10 == 3 else d, x + 1) for k, i, d, x in old]
    for rows in (old, paid, new):
        before, until = shuffled(), time.monotonic() + 20
        files.write_ledger(book(spark, *rows), path)
        while (left := shuffled() - before) and time.monotonic() < until:
            time.sleep(0.2)
        assert not left
    assert held(spark, path) == sorted(new + paid, key=str)
    assert not shared.exists() or not list(shared.iterdir())
    assert len(sizes) > 6 and max(sizes) <= 200
