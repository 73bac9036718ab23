"""Mix sources to target weights by entropy balancing.

Every document gets a rate, the number of times the mix should take it. Among all rates that give each source
its target of words and never exceed ``MOST`` copies, the one nearest to taking every document once (least
relative entropy) is an exponential tilt, ``min(MOST, exp(l * size))`` with one multiplier ``l`` per source:
the multipliers solve the convex dual. They are found by Newton steps over the whole corpus, each a
distributed sum of the dual's gradient and curvature; a step that leaves its bracket is halved instead.
The sums run over (source, size) with a count, since a rate depends on nothing else.

Rates become whole copies in two steps. Documents that hold over 1 / ``HEADS`` of their source, fewer than
``HEADS`` by definition, are rounded from the longest on, each taking over what the longer ones missed. The
rest make up for what these missed in all, and are rounded systematically: ordered by size and id, their rates
are summed as whole numbers of 2**-30, and a document takes as many copies as whole numbers its part of
the sum passes. So a source misses its target by about one of its short documents, and reruns agree.

Built-in functions only. A null text has size 0 and is taken without words. A null source is a source of its
own, ranked last. Repeated rows count each time. Columns other than the id, the source and the text
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import number_rows, running_totals
from ..session import pin
from .common import WORD, fresh

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # words of the mix, as a multiple of the corpus'
MOST = 2  # copies of a document, and words of a source as a multiple of its own
CLOSE = 1e-9  # of its target that a source's expected words may miss
ROUNDS = 100  # far beyond what halving the brackets to double precision takes
HEADS = 256
UNIT = 1 << 30  # rates are rounded in whole parts of 1 / UNIT


def sized(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", row_columns: Sequence[str] = ()
) -> DataFrame:
    """(id, source, size) and the ``row_columns``: words of every whole text."""
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), size.alias("size"), *row_columns)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rows, least, target) per source.

    Sources share the mix by weight; none gets more than ``most`` times its own size, and what the others
    then get more is found as one level ``t``: a target is min(cap, weight * t).
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )
    ranked = number_rows(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_n").drop("_null")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = pin(ranked.withColumn("weight", F.get(cycle, ((F.col("_n") - 1) % len(weights)).cast("int"))).drop("_n"))
    cap, level, capped = most * F.col("source_size"), 0.0, -1
    total = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # each round caps at least one more source, or ends
        full = F.col("weight") * level >= cap if capped >= 0 else F.lit(False)
        found = weighted.agg(
            F.sum(full.cast("int")), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if found[0] is None or found[0] == capped or not found[2]:
            break
        capped, level = found[0], (total - found[1]) / found[2]
    target = F.least(cap.cast("double"), F.col("weight") * level if capped >= 0 else F.lit(0.0))
    return weighted.select("source", "source_size", "rows", "least", target.alias("target"))


def rate(tilt: Column, size: Column, mean: Column, most: float = MOST) -> Column:
    """Copies of a document of ``size`` words; the tilt is per mean document of the source."""
    return F.least(F.lit(float(most)), F.exp(F.least(tilt * size / mean, F.lit(50.0))))


def tilts(sizes: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """(source, mean, tilt) per source, by Newton steps on the dual."""
    bins = pin(sizes.groupBy("source", "size").agg(F.count("*").alias("n")).filter("size > 0"))
    mean = F.col("source_size") / F.col("rows")
    # Bounds: at ``high`` every document is taken ``most`` times; at ``low`` the words stay under the target,
    # as size * exp(-l * size / mean) is mean / (l * e) at most.
    at = pin(
        targets.filter("source_size > 0").select(
            "source", "target", "source_size", mean.alias("mean"),
            (-F.col("source_size") / (F.exp(F.lit(1.0)) * F.col("target"))).alias("low"),
            (F.log(F.lit(float(most))) * mean / F.col("least")).alias("high"),
            F.lit(0.0).alias("tilt"), (F.col("target") >= most * F.col("source_size")).alias("done"),
        ).withColumn("tilt", F.when(F.col("done"), F.col("high")).otherwise(0.0))
    )
    kept = at.columns
    for _ in range(ROUNDS):
        taken = rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size") * taken
        slope = F.when(taken < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
        here = at.select(F.col("source").alias("_source"), "tilt", "mean")
        sums = bins.join(here, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(F.sum(words).alias("_words"), F.sum(slope).alias("_slope"))
        sums = sums.withColumnRenamed("source", "_source")
        miss = F.col("_words") - F.col("target")
        done = F.col("done") | (F.abs(miss) <= CLOSE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-13 * F.greatest(F.abs("high"), F.lit(1.0)))
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.when(F.col("_slope") > 0, F.col("tilt") - miss / F.col("_slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        next_tilt = F.when(F.col("done"), F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        moved = at.join(sums, F.col("source").eqNullSafe(F.col("_source"))).withColumns({"done": done, "low": low, "high": high})
        at = pin(moved.withColumn("tilt", next_tilt).select(*kept))
        if at.filter("not done").isEmpty():
            break
    return at.select("source", "mean", F.round("tilt", 12).alias("tilt"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    row_columns: Sequence[str] = (),
) -> DataFrame:
    """(id column, source, size, source_size, target, rate, copies) per row.

    ``row_columns`` are kept behind the size; they order rows of one size and id.
    """
    sizes = pin(sized(docs, id_column, source_column, text_column, row_columns))
    targets = pin(source_targets(sizes, weights, share, most))
    found = tilts(sizes, targets, most).withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    # Pinned, so that its true size is known and a small table is broadcast instead of shuffling all rows by source.
    by_source = pin(targets.join(found, same, "left").select(F.col("source").alias("_source"), "source_size", "target", "mean", "tilt"))
    rated = sizes.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    taken = F.when(F.col("size") > 0, rate(F.col("tilt"), F.col("size"), F.col("mean"), most)).otherwise(1.0)
    rated = rated.withColumn("rate", taken).drop("mean", "tilt")
    return whole_copies(rated, most, row_columns).withColumnRenamed("id", id_column)


def whole_copies(rated: DataFrame, most: int, row_columns: Sequence[str] = ()) -> DataFrame:
    """``copies`` of every row, 0 to ``most``, from its rate."""
    is_head = F.col("size") * HEADS > F.col("source_size")
    kept = rated.columns
    head = F.struct((-F.col("size")).alias("minus"), "id", *row_columns, "size", "source_size", "target", "rate")
    heads = rated.filter(is_head).groupBy("source").agg(F.sort_array(F.collect_list(head)).alias("heads"))
    rounded = F.expr(f"""aggregate(heads, struct(cast(0 as double) as missed, cast(array() as array<int>) as copies), (a, h) -> transform(
        array(cast(greatest(0, least({most}, round(h.rate + a.missed / h.size))) as int)),
        k -> struct(a.missed + (h.rate - k) * h.size as missed, concat(a.copies, array(k)) as copies))[0])""")
    heads = pin(heads.select("source", "heads", rounded.alias("done")))
    head_rows = heads.select(F.explode(F.arrays_zip("heads", F.col("done.copies").alias("copies"))).alias("x"), "source").select(
        *[F.col("source") if c == "source" else F.col(f"x.heads.{c}").alias(c) for c in kept], F.col("x.copies").alias("copies")
    )
    tail = rated.filter(~is_head)
    missed = heads.select(F.col("source").alias("_source"), F.col("done.missed").alias("_missed"))
    wanted = tail.groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("_tail")).withColumnRenamed("source", "_s")
    missed = pin(wanted.join(missed, F.col("_s").eqNullSafe(F.col("_source")), "left").select("_s", "_tail", F.coalesce("_missed", F.lit(0.0)).alias("_missed")))
    scale = F.when(F.col("_tail") > 0, F.greatest(F.lit(0.0), 1 + F.col("_missed") / F.col("_tail"))).otherwise(1.0)
    # Rounded, so that the order of adding up does not show.
    units = F.round(F.least(F.lit(float(most)), F.col("rate") * F.round(scale, 9)) * UNIT).cast("bigint")
    tail = tail.join(missed, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_units", units).select(*kept, "_units")
    summed = running_totals(tail, ["size", "id", *row_columns], {"_upto": "_units"}, ["source"], "bigint")
    whole = lambda c: F.shiftright(c + UNIT // 2, 30)
    copies = (whole(F.col("_upto")) - whole(F.col("_upto") - F.col("_units"))).cast("int")
    return summed.select(*kept, copies.alias("copies")).union(head_rows.select(*kept, "copies"))


def take_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as many times as it is taken, rows that share an id each by their own copies.

    The rows are numbered and pinned, so that both uses see the same numbers.
    """
    mark, row, mixed, many, copy = fresh(docs.columns, "_text_hash", "_row", "_mixed", "_copies", "_copy")
    numbered = pin(docs.withColumns({mark: F.xxhash64("text"), row: F.monotonically_increasing_id()}))
    copies = mix(numbered, row_columns=(mark, row)).filter("copies > 0")
    copies = copies.select(F.col(row).alias(mixed), F.col("copies").alias(many))
    taken = numbered.join(copies, F.col(row) == F.col(mixed))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(many))).alias(copy)).drop(copy)
