"""Balances of closed dates kept beside the stored ledger, so that a balance reads one snapshot and the days behind it.

A snapshot of a date holds, for each party and account, the sums of all postings with an earlier post date. It is made from the
snapshot before it and the days between. Read back it looks like postings, one a party and account, dated the day
before: whatever sums postings over all dates, or up to a date behind the snapshot, gives what it gives on the
whole ledger, and reads the days behind the snapshot only. Lists of single postings need the ledger itself.

``write_ledger`` takes away the snapshots behind the earliest date it touches before it changes anything, so a snapshot is never
stale, whenever a writer dies; a later ``take`` makes new ones from what is left.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import total, zero
from . import swap

FOLDER = "_balances"  # a name that readers of the ledger pass over
SUMS = "ref string, ref_id bigint, account string, debit decimal(20,2), credit decimal(20,2)"


def taken(spark: SparkSession, path: str) -> list[dt.date]:
    """The dates of the snapshots of a stored ledger."""
    names = swap.Folder(spark, f"{path}/{FOLDER}").names()
    return sorted(dt.date.fromisoformat(n.partition("=")[2]) for n in names if n.startswith("as_of="))


def drop_behind(spark: SparkSession, path: str, date: dt.date | None) -> None:
    """Take away the snapshots that hold postings of ``date``; open postings are in none."""
    folder = swap.Folder(spark, f"{path}/{FOLDER}")
    for day in taken(spark, path) if date else []:
        if day > date:
            folder.delete(f"as_of={day.isoformat()}")


def _since(spark: SparkSession, path: str, ledger: DataFrame, before: dt.date | None) -> DataFrame:
    """(ref, ref_id, account, debit, credit, post_date): the newest snapshot not behind ``before``, and what follows it."""
    columns = ["ref", "ref_id", "account", "debit", "credit", "post_date"]
    if before is not None:
        ledger = ledger.filter(F.col("post_date") < F.lit(before))
    days = [d for d in taken(spark, path) if before is None or d <= before]
    if not days:
        return ledger.select(*columns)
    day = days[-1]
    sums = spark.read.schema(SUMS).parquet(f"{path}/{FOLDER}/as_of={day.isoformat()}")
    sums = sums.withColumn("post_date", F.date_sub(F.lit(day), 1))
    later = F.col("post_date") >= F.lit(day)
    if before is None:
        later = later | F.col("post_date").isNull()
    return sums.select(*columns).union(ledger.filter(later).select(*columns))


def postings_before(spark: SparkSession, path: str, ledger: DataFrame, before: dt.date) -> DataFrame:
    """Postings that sum up like those of ``ledger`` with a post date before ``before``."""
    return _since(spark, path, ledger, before)


def all_postings(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """Postings that sum up like all of ``ledger``, open ones included."""
    return _since(spark, path, ledger, None)


def take(spark: SparkSession, path: str, ledger: DataFrame, as_of: dt.date) -> None:
    """Keep the sums of all postings before ``as_of``; nothing to do if they are kept already.

    Reads the newest earlier snapshot and the days between; written to a staged folder and put in place by one rename.
    """
    folder = swap.Folder(spark, f"{path}/{FOLDER}")
    name = f"as_of={as_of.isoformat()}"
    if folder.exists(name):
        return
    staged = swap.stage(spark, f"{path}/{FOLDER}")
    sums = _since(spark, path, ledger, as_of).groupBy("ref", "ref_id", "account").agg(
        F.coalesce(total("debit"), zero()).alias("debit"), F.coalesce(total("credit"), zero()).alias("credit")
    )
    sums.write.parquet(f"{path}/{FOLDER}/{staged}")
    folder.move(staged, name)
