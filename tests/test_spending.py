"""Balances that run out, against a loop over the requests."""

import random
from decimal import Decimal

import fixtures as fx
import pytest
from fixtures import D
from pyspark.sql import functions as F

from shelfbook.functions import allocation
from shelfbook.operators import spending

REQUESTS = "request_id bigint, order_id bigint, ct_consign_id bigint, requested decimal(20,2), use_amount decimal(20,2)"


def loop(requests, opening, cash, taken):
    """(request, balance, amount, left) by walking through the requests."""
    held, out = dict(opening), []
    for key, order, account, asked, named in sorted(requests, key=lambda r: (r[0], r[1])):
        if account not in held:
            continue
        balance = held[account] - taken.get(order, 0)
        bears = asked if asked < 0 else 0 if balance < 0 else min(balance, asked)
        amount = bears
        if bears < asked and named is not None:
            amount = min(named, bears) if cash[account] else named
        held[account] -= amount
        out.append((key, balance, amount, held[account], bears < asked, bears < asked and not cash[account]))
    return sorted(out)


def spend(spark, requests, opening, cash, taken):
    people = fx.consignors(spark, *[(a, cash[a], 1000 + a, 2000 + a, "0.4", None) for a in opening])
    book = fx.postings(spark, *[(a, True, "vendor" if a % 2 else "customer", (1000 if a % 2 else 2000) + a, "cc", "0", str(b)) for a, b in opening.items()])
    methods = spark.createDataFrame([(3, True), (1, False)], "payment_method_id bigint, store_credit boolean")
    paid = [(i, o, 3, D(t)) for i, (o, t) in enumerate(taken.items())] + [(99, 1, 1, D("77"))]
    paid = spark.createDataFrame(paid, "order_payment_id bigint, order_id bigint, payment_method_id bigint, amount decimal(20,2)")
    asked = spark.createDataFrame(requests, REQUESTS).repartition(4)
    got = spending.spend_store_credit(asked, None, people, book, paid, methods).collect()
    return sorted((r.request_id, r.balance, r.amount, r.left_balance, r.insufficient, r.may_overdraw) for r in got)


def test_one_balance_is_spent_once(spark):
    requests = [(1, 10, 1, D("80"), None), (2, 11, 1, D("80"), None), (3, 12, 1, D("80"), None), (4, 13, 1, D("-5"), None), (5, 14, 1, D("3"), None)]
    got = spend(spark, requests, {1: D("100")}, {1: True}, {})
    assert [(r[0], str(r[2]), str(r[3])) for r in got] == [
        (1, "80.00", "20.00"), (2, "20.00", "0.00"), (3, "0.00", "0.00"), (4, "-5.00", "5.00"), (5, "3.00", "2.00")
    ]


@pytest.mark.parametrize("rows", [3, 512])
@pytest.mark.parametrize("seed", range(2))
def test_any_requests_equal_the_loop(spark, monkeypatch, rows, seed):
    r = random.Random(seed)
    money = lambda a, b: Decimal(r.randint(a * 100, b * 100)) / 100
    opening = {a: money(-60, 400) for a in range(1, 9)}
    cash = {a: r.random() < 0.5 for a in opening}
    taken = {o: money(0, 30) for o in range(1, 200, 4)}
    hot = lambda: 1 if r.random() < 0.4 else r.randint(1, 9)  # noqa: E731  account 9 does not exist
    requests = [(i, r.randint(1, 300), hot(), money(-20, 40), money(0, 60) if r.random() < 0.3 else None) for i in range(150)]
    plain = allocation.in_turn
    monkeypatch.setattr(spending, "in_turn", lambda *a, **k: plain(*a, **k, rows=rows))
    assert spend(spark, requests, opening, cash, taken) == loop(requests, opening, cash, taken)


def test_a_hot_account_is_cut_into_slices(spark):
    """20,000 requests of one account, in 40 slices: the first round's guesses hold, and the sums are those of a loop."""
    requests = spark.range(20_000).select(
        F.col("id"), F.lit(7).alias("key"), (F.col("id") % 9 + 1).cast("decimal(20,2)").alias("asked"), F.lit("50000.50").cast("decimal(20,2)").alias("opening")
    )
    take = lambda found, row: F.least(found, row["asked"])
    got = allocation.in_turn(requests, "key", ["id"], "opening", take, "asked", ("found", "taken"))
    held = Decimal("50000.50")
    for row in got.orderBy("id").collect():
        assert row.found == held and row.taken == min(held, row.asked)
        held -= row.taken
    assert held == 0


def test_no_requests(spark):
    assert spend(spark, [], {1: D("100")}, {1: True}, {}) == []


def claims_of(rows, things):
    taken, granted = [set() for _ in things], []
    for row in sorted(rows):
        if all(row[t] not in used for t, used in zip(things, taken, strict=True)):
            granted.append(row)
            for t, used in zip(things, taken, strict=True):
                used.add(row[t])
    return granted


@pytest.mark.parametrize("things", [(1,), (0, 1)])
def test_first_claims_equal_the_loop(spark, things):
    r = random.Random(len(things))
    rows = sorted({(r.randint(0, 30), r.choice([1, 1, 1, r.randint(2, 40)])) for _ in range(150)}) + [(100 + i, 50 + i) for i in range(3)]
    rows += [(200 + i, 300 + i) for i in range(6)] + [(201 + i, 300 + i) for i in range(6)]  # a chain
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = allocation.first_claims(df, [("a", "b")[t] for t in things], ["a", "b"]).collect()
    assert len(got) == len(rows)
    assert sorted((x.a, x.b) for x in got if x.granted) == claims_of(rows, things)
    assert allocation.first_claims(df.limit(0), ["a"], ["a", "b"]).count() == 0


def test_a_card_pays_once(spark):
    requests = [(1, 7, 50), (2, 7, 50), (3, 7, 51), (4, 8, 50), (4, 8, 52), (5, 8, 52), (5, 8, 53), (6, 9, 53), (6, None, 53), (7, 8, 99), (8, 8, 53), (8, 8, 53), (77, 8, 54)]
    requests = spark.createDataFrame(requests, "order_id bigint, ct_consign_id bigint, gift_card_id bigint")
    orders = spark.createDataFrame([(i,) for i in range(1, 9)], "order_id bigint")
    lines = spark.createDataFrame([(2,)], "order_id bigint")
    owners = fx.consignors(spark, (7, True, 107, 77, "0.5", None), (8, True, 108, None, "0.5", None))
    cards = [(50, D("9.00"), True), (51, D("0.00"), False), (52, D("5.00"), True), (53, D("6.00"), True), (54, D("6.00"), True)]
    cards = spark.createDataFrame(cards, "gift_card_id bigint, balance decimal(20,2), available boolean")
    done = spending.cash_gifts(requests, orders, lines, owners, cards, gift_method=4)
    assert fx.rows(done.gifts, "order_id", "gift_card_id", "payment_amount") == [(1, 50, "9.00"), (4, 52, "5.00"), (5, 53, "6.00")]
    assert fx.rows(done.rejected, "order_id", "ct_consign_id", "gift_card_id", "reason") == sorted(
        [(2, 7, 50, spending.FILLED), (3, 7, 51, spending.SPENT), (4, 8, 50, spending.SPENT), (5, 8, 52, spending.SPENT),
         (6, 9, 53, spending.NO_ACCOUNT), (6, None, 53, spending.NO_ACCOUNT), (7, 8, 99, spending.NO_CARD), (8, 8, 53, spending.SPENT)],
        key=str,
    )


@pytest.mark.parametrize("run", [3, 64])
def test_wrong_guesses_are_put_right_a_run_at_a_time(spark, monkeypatch, run):
    """Overdrafts and refunds make every guess wrong; the rounds are those of a key's runs, not of its slices."""
    r = random.Random(run)
    rows = [(i, r.randint(1, 2), Decimal(r.randint(-300, 900))) for i in range(240)]
    requests = spark.createDataFrame(rows, "id bigint, key bigint, asked decimal(20,2)").withColumn("opening", F.lit(500).cast("decimal(20,2)"))
    take = lambda found, row: F.when(row["asked"] <= found, row["asked"]).otherwise(F.lit(7).cast("decimal(20,2)"))
    pins = []
    monkeypatch.setattr(allocation, "RUN", run, raising=False)
    monkeypatch.setattr(allocation, "pin", lambda *a, pin=allocation.pin: pins.append(1) or pin(*a))
    got = allocation.in_turn(requests, "key", ["id"], "opening", take, "asked", ("found", "taken"), rows=10).collect()
    held, want = {1: Decimal(500), 2: Decimal(500)}, []
    for i, key, asked in rows:
        taken = asked if asked <= held[key] else Decimal(7)
        want.append((i, held[key], taken))
        held[key] -= taken
    assert sorted((x.id, x.found, x.taken) for x in got) == want
    assert len(pins) <= 3 + 15 // run
