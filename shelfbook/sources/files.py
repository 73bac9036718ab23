"""Bulk load of tab-separated lists and the stored ledger."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Sequence
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import FREED, pin, pinned, settings
from . import snapshots, swap

# Columns of the gift-card list, the row that ends the data, the NULL mark and the
# escapes of the tab-separated bulk format.
GIFT_CARD_COLUMNS = {
    "legacy_code": "string", "name": "string", "amount": "decimal(10,2)", "balance": "decimal(10,2)",
}
END_OF_DATA = "\\."
NULL_MARK = "\\N"
ESCAPES = {"\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\v": "\v"}


# A byte of one to three octal digits, or of x and one or two hex digits; any other character stands for itself.
PIECE = r"(?s)(\\(?:[0-7]{1,3}|x[0-9A-Fa-f]{1,2}|.)|[^\\]+|\\$)"


def _unescaped(text: Column) -> Column:
    """A cell with its escapes resolved, piece by piece from the left; a backslash before any other character is dropped.

    Bytes given as numbers are joined to the bytes around them, so that several may make up one character.
    """

    def plain(piece: Column) -> Column:
        body = F.substring(piece, 2, 1 << 30)
        value = F.when(~piece.startswith("\\"), F.encode(piece, "UTF-8"))
        octal = F.conv(body, 8, 10).cast("int") % 256
        value = value.when(body.rlike("^[0-7]{1,3}$"), F.unhex(F.lpad(F.hex(octal), 2, "0")))
        value = value.when(body.rlike("^x[0-9A-Fa-f]{1,2}$"), F.unhex(F.lpad(F.substring(body, 2, 2), 2, "0")))
        for written, meant in ESCAPES.items():
            value = value.when(piece == written, F.encode(F.lit(meant), "UTF-8"))
        return value.otherwise(F.encode(body, "UTF-8"))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), 1), plain)
    whole = F.decode(F.aggregate(pieces, F.lit(b""), lambda a, p: F.concat(a, p)), "UTF-8")
    return F.when(F.instr(text, "\\") > 0, whole).otherwise(text)


def _escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, e: F.replace(t, F.lit(ESCAPES[e]), F.lit(e)), ESCAPES, doubled)


def read_gift_card_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated gift-card list; a row that does not fit keeps its text in ``rejected``."""
    lines = spark.read.text(path).filter(F.col("value") != END_OF_DATA)
    cells = F.split("value", "\t", -1)
    fits, columns = F.size(cells) == len(GIFT_CARD_COLUMNS), []
    for i, (name, kind) in enumerate(GIFT_CARD_COLUMNS.items()):
        cell = F.get(cells, F.lit(i))
        value = F.when(cell != NULL_MARK, _unescaped(cell)).try_cast(kind)
        fits = fits & ((cell == NULL_MARK) | value.isNotNull())
        columns.append(value.alias(name))
    return lines.select(*columns, F.when(~F.coalesce(fits, F.lit(False)), F.col("value")).alias("rejected"))


def load_gift_cards(spark: SparkSession, path: str) -> DataFrame:
    """The usable rows; codes stay text, so leading zeros survive."""
    return read_gift_card_rows(spark, path).filter(F.col("rejected").isNull()).drop("rejected")


def rejected_gift_cards(spark: SparkSession, path: str) -> DataFrame:
    """The text of rows that do not fit."""
    return read_gift_card_rows(spark, path).select("rejected").filter(F.col("rejected").isNotNull())


def save_gift_cards(cards: DataFrame, path: str) -> None:
    """Write cards as a tab-separated list in the form ``load_gift_cards`` reads."""
    cells = [F.coalesce(_escaped(F.col(c).cast("string")), F.lit(NULL_MARK)) for c in GIFT_CARD_COLUMNS]
    cards.select(F.concat_ws("\t", *cells)).write.mode("overwrite").text(path)


LEDGER = (
    "trans_id bigint, trans_ref string, trans_ref_id bigint, ref string, ref_id bigint, account string, "
    "debit decimal(20,2), credit decimal(20,2), post_date date"
)


TRANSACTIONS = "trans_id bigint, ref string, ref_id bigint, ref_date date, description string, post_date date"

# Shuffled bytes that go to one file of a stored table.
FILE_BYTES = 32 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Rows that are shuffled at a time on their way to the files. Every portion reads the pinned rows anew, so few are better.
PORTION_ROWS = 250_000_000


def _write_by(period: str, df: DataFrame, path: str, mode: str, *order: str, commit: int = 1) -> None:
    """Store by a period of posting; busy periods are split and small ones packed, and files are sorted.

    ``commit=2`` lets every task put its own files in place, for folders that nobody reads before the job has ended.
    """
    with settings(df.sparkSession, {ADVISORY: str(FILE_BYTES)} | FREED):
        (
            df.hint("rebalance", period)
            .sortWithinPartitions(period, *order)
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .option("mapreduce.fileoutputcommitter.algorithm.version", str(commit))
            .partitionBy(period)
            .parquet(path)
        )


NO_PERIOD = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of rows without a period


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _within(period: str, days: list) -> Column:
    """Rows of the listed periods, as a filter that prunes partitions."""
    named = [d for d in days if d is not None]
    wanted = F.col(period).isin(named) if named else F.lit(False)
    return wanted | F.col(period).isNull() if None in days else wanted


def _between(documents: DataFrame, keys: Sequence[str]) -> Column:
    """Rows that may be of one of the documents, by the first and last value of each key; a null key goes with null ones."""
    ends = documents.agg(*[F.struct(F.min(k).alias("a"), F.max(k).alias("z"), F.count_if(F.col(k).isNull()).alias("n")).alias(k) for k in keys]).first()
    wanted = F.lit(True)
    for k in keys:
        within = F.lit(False) if ends[k].a is None else F.col(k).between(ends[k].a, ends[k].z)
        wanted = wanted & (within | F.col(k).isNull() if ends[k].n else within)
    return wanted


def _stored(spark: SparkSession, path: str, period: str) -> DataFrame:
    """The table with every column its files have; the period is a date even where no folder tells so."""
    found = spark.read.parquet(path).drop(period).schema
    return spark.read.schema(found.add(period, "date")).parquet(path)


def _counted(df: DataFrame, period: str) -> Counter:
    """Rows of each period; the driver holds one number per day or month."""
    return Counter({row[0]: row[1] for row in df.groupBy(period).count().collect()})


def _portions(rows: Counter, period: str, keys: Sequence[str]) -> list[Column]:
    """Filters that deal out the counted periods in portions of ``PORTION_ROWS``: small periods packed, busy ones split by document."""
    portions, pack, size = [], [], 0
    for day in sorted(rows, key=lambda d: (d is None, d or dt.date.min)):
        parts = -(-rows[day] // PORTION_ROWS)
        if parts > 1:
            turn = F.pmod(F.xxhash64(*keys), F.lit(parts))
            portions += [_within(period, [day]) & (turn == i) for i in range(parts)]
            continue
        if pack and size + rows[day] > PORTION_ROWS:
            portions.append(_within(period, pack))
            pack, size = [], 0
        pack.append(day)
        size += rows[day]
    return [*portions, _within(period, pack)] if pack else portions


def _upsert(period: str, rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], anywhere: bool) -> None:
    """Put documents in the place of what is stored of them.

    Only periods that hold or will hold one of the documents are read and written; they are staged and swapped in. The rows are
    pinned first and go to their files in portions, so that the disk holds what making them shuffles, or one portion's
    shuffles, beside the rows, the table and its new periods.
    """
    spark = rows.sparkSession
    staged = swap.stage(spark, path)
    held = [n for n in swap.Folder(spark, path).names() if n.startswith(f"{period}=")]
    with settings(spark, FREED), ExitStack() as pins:
        rows = pins.enter_context(pinned(rows))
        counts = _counted(rows, period)
        if held:
            documents = pins.enter_context(pinned(rows.select(*keys).distinct()))
            stored = _stored(spark, path, period)
            touched = [*counts]
            if anywhere:
                # Periods that get rows are read anyway; files that hold no name between the first and the last are passed over.
                other = stored.filter(~F.coalesce(_within(period, touched), F.lit(False)) & _between(documents, keys))
                found = other.join(documents, _same(other, documents, keys), "left_semi").select(period)
                touched += [row[0] for row in found.distinct().collect()]
            there = stored.filter(_within(period, touched))
            counts += _counted(there, period)
        for portion in _portions(counts, period, keys):
            whole = rows.filter(portion)
            if held:
                near = there.filter(portion)
                kept = near.join(documents, _same(near, documents, keys), "left_anti")
                whole = kept.unionByName(whole, allowMissingColumns=True)
            _write_by(period, whole, f"{path}/{staged}", "append", *order, commit=2)
    if not held:
        snapshots.drop_behind(spark, path, dt.date.min)
        return swap.publish(spark, path, staged, [])
    names = {f"{period}={NO_PERIOD if d is None else d.isoformat()}" for d in touched}
    snapshots.drop_behind(spark, path, min((d for d in touched if d is not None), default=None))
    swap.publish(spark, path, staged, [n for n in held if n in names])


def _store(period: str, rows: DataFrame, path: str, mode: str, keys: Sequence[str], order: Sequence[str], anywhere: bool) -> None:
    if mode == "upsert":
        return _upsert(period, rows, path, keys, order, anywhere)
    spark = rows.sparkSession
    swap.finish(spark, path)
    if snapshots.taken(spark, path):
        rows = pin(rows)
        snapshots.drop_behind(spark, path, rows.agg(F.min(period)).first()[0])
    _write_by(period, rows, path, mode, *order)


def write_ledger(postings: DataFrame, path: str, mode: str = "upsert", anywhere: bool = True) -> None:
    """Store postings by post date.

    Within a file postings lie by account and party, so that a balance of one account skips most row
    groups. A document is what (trans_ref, trans_ref_id) name, null ones included, or trans_id where these are no columns. Its postings take the place of
    those stored of it, on whatever date these are; other documents of a date stay. A run that is repeated, or
    ended at any step and repeated, leaves each document once, and readers see all of a run or nothing.
    ``anywhere=False`` looks for stored documents on the dates of ``postings`` only, for documents that never change their date;
    else the documents' names are read on all dates. ``mode='overwrite'`` replaces whole dates by the postings
    given, ``mode='append'`` adds without looking.
    """
    keys = [k for k in ("trans_ref", "trans_ref_id") if k in postings.columns] or ["trans_id"]
    _store("post_date", postings, path, mode, keys, ["account", "ref", "ref_id"], anywhere)


def write_transactions(transactions: DataFrame, path: str, mode: str = "upsert", anywhere: bool = True) -> None:
    """Store the headers of the ledger beside its postings, by month, as they are few; files lie by document.

    Modes are those of ``write_ledger``; a document is what (ref, ref_id) name, with all of its headers.
    """
    monthly = transactions.withColumn("post_month", F.trunc("post_date", "month"))
    _store("post_month", monthly, path, mode, ["ref", "ref_id"], ["ref", "ref_id"], anywhere)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    swap.finish(spark, path)
    return spark.read.schema(f"{TRANSACTIONS}, post_month date").parquet(path).drop("post_month")


def take_snapshot(spark: SparkSession, path: str, as_of: dt.date) -> None:
    """Keep the balances before a date beside the stored ledger (``snapshots``)."""
    snapshots.take(spark, path, read_ledger(spark, path), as_of)


def read_balances(spark: SparkSession, path: str, before: dt.date | None = None) -> DataFrame:
    """Postings that sum up like the stored ones, all or those before a date, from the newest snapshot and the days behind it."""
    ledger = read_ledger(spark, path)
    return snapshots.all_postings(spark, path, ledger) if before is None else snapshots.postings_before(spark, path, ledger, before)


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """The stored postings. The schema is given, as a folder with open postings only does not tell the date's type."""
    swap.finish(spark, path)
    return spark.read.schema(schema).parquet(path)
