"""Drawing on balances that run out: requests of a key one after another, and claims that exclude each other.

Both stay distributed however many requests a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .keys import running_totals
from .money import MONEY

SLICE = 512  # requests that one fold takes
RUN = 64  # slices of a key that one task walks through in order
Step = Callable[[Column, Column], Column]


def in_turn(
    requests: DataFrame, key: str, order_by: Sequence[str], opening: str, amount: Step, asked: str, out: tuple[str, str], rows: int = SLICE
) -> DataFrame:
    """``requests`` with what each finds and takes: (balance before it, amount) as the columns of ``out``.

    The first request of a key finds ``opening`` (equal in all of its rows), each further one what the one before it left.
    ``amount`` gives what a request takes from the balance it finds and its row; any function will do. ``order_by`` must be unique
    within a key, no null.

    A key's requests are numbered and cut into slices of ``rows``, which are folded each by itself. The first slice of
    a key knows its opening. The others begin with a guess, that every earlier request took the ``asked`` column as long as something
    was left. Where guesses were wrong, a task walks through ``RUN`` slices of a key one after the other, folding those again that
    do not begin with what the one before them left: runs of all keys at a time, those of a key one after the other. Guesses are
    right unless requests take less or more than asked; at worst every request is folded once more, in as many
    rounds as a key has runs.
    """
    found, taken = out
    numbered = running_totals(requests.withColumn("_one", F.lit(1)), order_by, {"_n": "_one", "_upto": asked}, [key])
    slices = numbered.withColumn("_slice", F.floor((F.col("_n") - 1) / rows).cast("bigint")).groupBy(key, "_slice")
    item = F.struct("_n", *requests.columns)
    cut = slices.agg(
        F.sort_array(F.collect_list(item)).alias("_items"), F.any_value(opening).alias("_opening"),
        F.min_by(F.col("_upto") - F.col(asked), "_n").alias("_before"),
    ).withColumn("_run", F.floor(F.col("_slice") / RUN).cast("bigint"))
    cut = pin(cut.hint("rebalance", "_run"), "_run")  # a round reads its run only
    left = F.col("_opening") - F.col("_before")
    guess = F.when((F.col("_opening") < 0) | (F.col("_slice") == 0), F.col("_opening")).otherwise(F.greatest(left, F.lit(0)))
    cut = cut.withColumn("_start", guess.cast(MONEY)).drop("_opening", "_before")

    def after(balance: Column, row: Column) -> Column:
        return (balance - amount(balance, row).cast(MONEY)).cast(MONEY)

    def walk(done: Column, piece: Column) -> Column:
        real = F.element_at(done, -1)["_end"]
        end = F.when(real == piece["_start"], piece["_end"]).otherwise(F.aggregate(piece["_items"], real, after))
        return F.concat(done, F.array(F.struct(piece["_slice"].alias("_slice"), real.alias("_start"), end.alias("_end"))))

    many = cut.filter("_slice > 0").select(key).distinct()  # keys of several slices: at most one in ``rows`` requests
    ends = F.aggregate("_items", F.col("_start"), after).alias("_end")
    settled = pin(cut.join(many, key, "left_semi").select(key, "_run", "_slice", "_start", ends))
    in_order = Window.partitionBy(key).orderBy("_slice")
    while True:
        told = settled.withColumn("_real", F.lag("_end").over(in_order))  # one row a slice
        wrong = told.filter(F.col("_real") != F.col("_start"))
        run = wrong.agg(F.min("_run")).first()[0]
        if run is None:
            break
        # All runs before this one are right, so that it begins with what is known.
        hit = told.join(wrong.filter(F.col("_run") == run).select(key).distinct(), key, "left_semi").filter(F.col("_run") == run)
        pieces = hit.join(cut.filter(F.col("_run") == run).select(key, "_slice", "_items"), [key, "_slice"])
        piece = F.struct("_slice", "_start", "_end", "_items")
        each = pieces.groupBy(key).agg(
            F.sort_array(F.collect_list(piece)).alias("_pieces"), F.min_by(F.coalesce("_real", "_start"), "_slice").alias("_begin")
        )
        none = F.lit(-1).cast("bigint").alias("_slice"), F.lit(None).cast(MONEY).alias("_start"), F.col("_begin").alias("_end")
        walked = F.aggregate("_pieces", F.array(F.struct(*none)), walk)
        again = each.select(key, F.explode(F.slice(walked, 2, RUN)).alias("_x")).select(key, F.lit(run).cast("bigint").alias("_run"), "_x.*")
        settled = pin(settled.join(again.select(key, "_slice"), [key, "_slice"], "left_anti").select(*settled.columns).unionByName(again))
    known = settled.select(key, "_slice", F.col("_start").alias("_known"))
    last = cut.join(known, [key, "_slice"], "left").withColumn("_start", F.coalesce("_known", "_start"))
    # What each request of a slice finds, and at the end what the last one leaves.
    balances = F.aggregate("_items", F.array("_start"), lambda sofar, row: F.concat(sofar, F.array(after(F.element_at(sofar, -1), row))))
    each = last.select("_items", balances.alias("_found")).select(
        F.explode(F.arrays_zip(F.col("_items").alias("row"), F.col("_found").alias("found"), F.slice("_found", 2, 1 << 30).alias("left"))).alias("_x")
    ).filter(F.col("_x.row").isNotNull())
    return each.select(
        *[F.col(f"_x.row.{c}").alias(c) for c in requests.columns], F.col("_x.found").alias(found),
        (F.col("_x.found") - F.col("_x.left")).cast(MONEY).alias(taken),
    )


def first_claims(claims: DataFrame, things: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``claims`` with ``granted``: in order, a claim is granted if all of its ``things`` are still free, and takes them.

    Each round grants the claims that come first for all of their things, and settles those that want one of these. ``order_by``
    must be unique and not null. Rounds are few unless things form long chains of claims in order.
    """
    turn = F.struct(*order_by)
    open_claims, done = pin(claims.withColumn("_turn", turn)), []
    while not open_claims.isEmpty():
        at = open_claims
        for i, thing in enumerate(things):
            first = open_claims.groupBy(F.col(thing).alias("_thing")).agg(F.min("_turn").alias(f"_first{i}"))
            at = at.join(first, F.col(thing) == F.col("_thing")).drop("_thing")
        firsts = [f"_first{i}" for i in range(len(things))]
        is_first = F.lit(True)
        for f in firsts:
            is_first = is_first & (F.col("_turn") == F.col(f))
        judged = pin(at.withColumn("granted", is_first).drop(*firsts))
        granted = judged.filter("granted")
        lost = None
        rest = judged.filter("not granted")
        for thing in things:
            taken = granted.select(F.col(thing).alias("_thing")).distinct()
            hit = rest.join(taken, F.col(thing) == F.col("_thing"), "left_semi")
            lost = hit if lost is None else lost.union(hit)
            rest = rest.join(taken, F.col(thing) == F.col("_thing"), "left_anti")
        done += [granted, lost]
        if len(things) == 1:
            break
        open_claims = pin(rest.drop("granted"))
    if not done:
        return claims.withColumn("granted", F.lit(False))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select(*claims.columns, "granted")
