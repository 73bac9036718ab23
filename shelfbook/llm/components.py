"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a, b) with a > b."""
    both = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    root = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(root, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the component's smallest node.

    ``links`` holds (a, b) with a > b. Each round is a few shuffles of the links, which only shrink; the
    number of rounds grows with the logarithm of a component's length. Every round is written to the
    shared folder, so a lost executor costs that round only. The driver sees a count and a checksum.
    """
    at = pin(links.select("a", "b").distinct())
    mark = None
    while True:
        now = at.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or now[0] == 0:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, at = now, pin(_stars(at))
