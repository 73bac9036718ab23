"""Ranges of ids that runs reserve before they give them out, kept as a small file per claim.

Runs at the same time get ranges that do not meet, and a run that is repeated gets the range it had. The target is
not scanned for its highest id, but for the first claim.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import number_rows
from .swap import Folder


def claims(spark: SparkSession, path: str) -> list[dict]:
    """(claim, first, count) of every claim, in the order they were made."""
    folder = Folder(spark, path)
    return [json.loads(folder.read(n)) for n in sorted(folder.names()) if n.endswith(".range")]


def reserve(spark: SparkSession, path: str, claim: str, count: int, existing: DataFrame, key: str) -> int:
    """The first id of the range of ``count`` ids that ``claim`` has or now gets.

    A claim is made by the file of its number, which only one of several runs can put in place; the others look again. The first
    range begins behind the highest ``key`` of ``existing``, every other one behind the range before it.
    """
    folder = Folder(spark, path)
    while True:
        known = claims(spark, path)
        own = next((c for c in known if c["claim"] == claim), None)
        if own:
            if own["count"] != count:
                raise ValueError(f"claim {claim} holds {own['count']} ids, not {count}")
            return own["first"]
        if known:
            first = known[-1]["first"] + known[-1]["count"]
        else:
            first = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).first()[0] + 1
        if folder.write_new(f"{len(known):012d}.range", json.dumps({"claim": claim, "first": first, "count": count})):
            return first


def reserved_ids(path: str, claim: str, existing: DataFrame, key: str, new: DataFrame, order_by: Sequence[str], out: str) -> DataFrame:
    """``new`` with ids from the range of ``claim``; repeated with the same rows it gives the same ids."""
    first = reserve(new.sparkSession, path, claim, new.count(), existing, key)
    return number_rows(new, order_by, "_n").withColumn(out, F.col("_n") + (first - 1)).drop("_n")
