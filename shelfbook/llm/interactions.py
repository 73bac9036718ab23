"""Filter interaction audit: what each filter removes in every order of the filters, counted from masks.

A document has a mask with a bit for each filter it fails, whatever other filters do. All figures of all orders are sums
over the counts of the masks, 32 for five filters, so the corpus is counted once and no order is run.

Four filters look at one text; the fifth asks for an equal text with a smaller id anywhere in the table. For it a counting
Bloom sketch goes ahead: every text adds one to four cells, tasks count their own texts, and the sums of all tasks
leave a bit per cell, set where at least two texts met. A text with a cell of its own has no copy and is cleared; the
others, copies and few more, are shuffled whole, combined in each task first, and give the smallest id of each text that is
there twice. The sketch has ``CELLS`` cells a document, up to the bound of ``bits`` (a bit each is what travels to the
tasks); beyond that fewer texts are cleared, and the result stays the same. A document meets its text's smallest id by the
SHA-256 digest of the text, which is checked to name one text only.

A null text is empty: it has no words and fails the first filter. A null language counts as an empty one. A null id is no
one's smaller id; a row without an id has a copy if any row with an id has its text, and rows that repeat id and text are no
copies of each other. A document is good or toxic if any label of its id says so. Other columns are ignored. No
documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import bits, words
from .common import small_batches

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
FEWEST_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = b"#$%&*|"
CELLS = 8  # of the sketch, for a document
_UPPER, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def text_mask(raw: bytes) -> int:
    """The bits of the filters that a text fails by itself."""
    many, distinct = 0, set()
    for part in words.stretches(raw):
        found = part.split()
        many += len(found)
        distinct.update(found)
    upper, points = len(raw) - len(raw.translate(None, _UPPER)), len(raw.translate(None, _CONTINUED))
    fails = (
        many < FEWEST_WORDS,
        100 * len(distinct) < DISTINCT_PERCENT * many,
        100 * upper > UPPER_PERCENT * points,
        len(raw) != len(raw.translate(None, SYMBOLS)),
    )
    return sum(bit << i for i, bit in enumerate(fails))


def text_flags(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(id, part, hash, digest, mask) per row; the mask lacks the bit of copies."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                raw, at = words.text_bytes(piece.column(3))
                texts = [raw[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                mask = pa.array([text_mask(t) for t in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], digest, mask], ["id", "part", "hash", "digest", "mask"])

    text = F.coalesce(text_column, F.lit(""))
    plain = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("hash"), text.alias("text"),
    )
    return small_batches(plain).mapInArrow(rows, "id bigint, part string, hash bigint, digest binary, mask int")


def sketch(hashed: DataFrame, size: int) -> np.ndarray:
    """The merged counts as bits: the cells that two texts or more add to."""
    return bits.collect(bits.counted(hashed, size).filter("n > 1"), size)


def first_ids(docs: DataFrame, flags: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = bits.MOST) -> DataFrame:
    """(digest, first) of every text that at least two rows hold; ``first`` is its smallest id."""
    met = sketch(flags, bits.size_for(flags.count(), CELLS, most))
    text = F.coalesce(text_column, F.lit(""))
    plain = docs.select(F.col(id_column).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    repeats = plain.filter(bits.all_set(met, F.col("hash"), docs.sparkSession)).groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    found = pin(repeats.filter("n > 1").select(F.unhex(F.sha2("text", 256)).alias("digest"), "first"))
    if not found.groupBy("digest").count().filter("count > 1").isEmpty():
        raise ValueError("two texts share a digest")
    return found


def mask_counts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of the mask."""
    flags = pin(text_flags(docs, id_column, text_column, part_column))
    firsts = first_ids(docs, flags, id_column, text_column)
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    whole = flags.join(firsts, "digest", "left").select(
        "id", "part", F.when(later, F.col("mask") + (1 << COPY)).otherwise(F.col("mask")).alias("mask")
    )
    said = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(said("quality"), said("toxic"))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    joined = whole.join(marks, "id", "left").groupBy("part", "mask")
    return joined.agg(F.count("*").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of masks."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    names = ["".join(p) for p in permutations(filters)]
    steps = cells.select("part", "cells", F.explode(F.array(*map(F.lit, names))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    place = lambda f: F.instr("filter_order", f)
    here = sum((F.when(place(f) == F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    before = sum((F.when(place(f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    steps = steps.withColumns({"here": here.cast("int"), "before": before.cast("int")})

    def total(where: str, what: str = "n") -> Column:
        return F.expr(f"aggregate(filter(cells, x -> {where}), 0L, (a, x) -> a + x.{what})")

    removed = "x.mask & here <> 0 and x.mask & before = 0"
    shares = f"aggregate(filter(cells, x -> x.mask & here <> 0), 0L, (a, x) -> a + x.n * ({factorial(len(filters))} div bit_count(x.mask)))"
    return steps.select(
        "part", "filter_order", "step",
        total("x.mask & (here | before) = 0").alias("kept"),
        total(removed).alias("removed"),
        total("x.mask & here <> 0 and x.mask & before <> 0").alias("redundant"),
        total("x.mask = here").alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.expr(shares).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Counts of every order and step of the five filters, by part."""
    return orders(pin(mask_counts(docs, labels, **columns)))


def audit_sql() -> str:
    """The audit of ``documents`` and ``labels`` as DuckDB SQL, by running every order over the documents' masks."""
    word = r"[^\x20\x09-\x0D]+"
    letters = " UNION ALL ".join(f"SELECT '{f}' AS f, {1 << i} AS bit" for i, f in enumerate(FILTERS))
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, (len(ws) < {FEWEST_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {UPPER_PERCENT} * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (first IS NOT NULL AND (texts.doc_id IS NULL OR texts.doc_id > first))::INT AS mask,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = texts.doc_id
), letters AS ({letters}), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, f, bit, instr(filter_order, f)::INT AS step,
    (SELECT coalesce(sum(o.bit), 0)::INT FROM letters o WHERE instr(filter_order, o.f) < instr(filter_order, letters.f)) AS before
  FROM orders, letters
), grouped AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask
), counted AS (
  SELECT part, filter_order, f, step,
    sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM grouped, steps GROUP BY part, filter_order, f, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM counted"""
