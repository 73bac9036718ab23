"""Structured Streaming forms of the daily payment report, the name trigger and the till.

Every stream writes one folder per micro-batch and overwrites it when the batch is repeated, so a
restart after a lost executor or driver gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.keys import running_totals
from ..functions.money import is_true, money, total
from ..operators.sales import payment_class
from ..session import pin
from ..sources.shop import Shop
from ..sources.swap import STAGED, Folder


class StreamShop(Shop):
    """The shop's tables read as streams of files, each table being one file or a folder of them."""

    def table(self, name: str) -> DataFrame:
        schema = super().table(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parquet*")


def run(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Start a stream over what is there now."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )


def keep_batches(folder: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")


def kept_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All written rows with their batch; none if no batch ran."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/rows/batch=-1")
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/rows")


def latest_rows(spark: SparkSession, folder: str, keys: list[str], schema: str) -> DataFrame:
    """The newest version of each key among the written batches."""
    rows = kept_rows(spark, folder, schema)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("_v"))
    return newest.select(*keys, *[f"_v.{v}" for v in values])


DAILY = "day date, type string, total decimal(20,2)"
NAMES = "ref string, ref_id bigint, new_name string"
TILLS = "location_id bigint, process_ts timestamp_ntz, customer_payment_id bigint, payment_method_id bigint, cash_balance decimal(20,2)"


def daily_payments(payments: DataFrame, methods: DataFrame) -> DataFrame:
    """Running totals per day and payment class. However late, a payment counts: the state is two rows a day."""
    kinds = methods.select("payment_method_id", "store_credit", "gift_card")
    return (
        payments.join(kinds, "payment_method_id")
        .groupBy(F.to_date("process_ts").alias("day"), payment_class().alias("type"))
        .agg(total("amount").alias("total"))
    )


def daily_payments_report(shop: Shop, folder: str) -> DataFrame:
    source = StreamShop(shop.spark, shop.sf_dir)
    stream = daily_payments(source.customer_payments, shop.methods)
    run(stream, folder, keep_batches(folder), mode="update").awaitTermination()
    return latest_rows(shop.spark, folder, ["day", "type"], DAILY)


SUMS = "day date, type string, total decimal(20,2)"
FOLD = 50  # batches after which the sums of days are put together


def _day_sums(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The sums that are in force, a row or more a day and class, and the last batch that was put together."""
    place = Folder(spark, folder)
    base = max((int(n.partition("=")[2]) for n in place.names("base") if n.startswith("upto=")), default=-1)
    parts = [f"base/upto={base}"] if base >= 0 else []
    parts += [f"days/{n}" for n in place.names("days") if n.startswith("batch=") and int(n.partition("=")[2]) > base]
    if not parts:
        return spark.createDataFrame([], SUMS), base
    return spark.read.schema(SUMS).parquet(*[f"{folder}/{p}" for p in parts]), base


def _added_up(sums: DataFrame) -> DataFrame:
    return sums.groupBy("day", "type").agg(total("total").alias("total"))


def _fold(spark: SparkSession, folder: str, number: int) -> None:
    """Put the sums up to a batch together; older parts go when the new one is in place."""
    place = Folder(spark, folder)
    if not place.exists(f"base/upto={number}"):
        staged = f"base/{STAGED}{number}"
        _added_up(_day_sums(spark, folder)[0]).write.mode("overwrite").parquet(f"{folder}/{staged}")
        place.move(staged, f"base/upto={number}")
    for kind, name in (("base", "upto="), ("days", "batch=")):
        for n in place.names(kind):
            if n.startswith(name) and int(n.partition("=")[2]) < number + (kind == "days"):
                place.delete(f"{kind}/{n}")


def daily_sums(payments: DataFrame, methods: DataFrame, folder: str, fold: int = FOLD) -> StreamingQuery:
    """Payments per day and class without any state in the stream: a batch adds its own sums, late money to its own day.

    Every ``fold`` batches the sums are put together, so what is kept and read is a row per day and class and a few
    batches' rows, however long the stream runs.
    """

    def carry(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number > _day_sums(spark, folder)[1]:  # else a repeat of a batch that is in the base already
            daily_payments(batch, methods).write.mode("overwrite").parquet(f"{folder}/days/batch={number}")
        if number % fold == fold - 1:
            _fold(spark, folder, number)

    return run(payments, folder, carry)


def daily_sums_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _added_up(_day_sums(spark, folder)[0])


def daily_sums_report(shop: Shop, folder: str) -> DataFrame:
    source = StreamShop(shop.spark, shop.sf_dir)
    daily_sums(source.customer_payments, shop.methods, folder).awaitTermination()
    return daily_sums_rows(shop.spark, folder)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class NameKeeper(StatefulProcessor):
    """Of an account: the name it has. Edits of a batch come in any order and one at a time; the last one counts."""

    def __init__(self, edit_order: str | None):
        self.edit_order = edit_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.name = handle.getValueState("name", "name string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.name.update((initialState.name,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = None
        for row in rows:
            if last is None or not self.edit_order or row[self.edit_order] >= last[self.edit_order]:
                last = row
        old = self.name.get()
        if last["name"] is None:
            return
        if old is not None and old[0] is not None and old[0] != last["name"]:
            yield Row(new_name=last["name"], vendor_id=last["vendor_id"], customer_id=last["customer_id"])
        self.name.update((last["name"],))

    def close(self) -> None:
        pass


def name_sync(renamed: DataFrame, before: DataFrame, folder: str, edit_order: str | None = None) -> StreamingQuery:
    """Names to write to vendors and customers as account edits arrive.

    The name of every account is kept in the stream's state store: it begins with ``before``, loaded once, and a batch
    reads and writes the states of its own accounts alone. Old versions of states are removed by the store. Of several
    edits of an account in one batch the last by ``edit_order`` (a time or sequence column, no null) counts; without
    such a column a batch must hold one edit per account. An edit without a name changes nothing, the first name of an
    account unknown before is kept and gives no row. Edits without an account id are left out.
    """
    edits = renamed.filter("ct_consign_id is not null")
    known = before.filter("ct_consign_id is not null").groupBy("ct_consign_id").agg(F.max("name").alias("name"))
    changed = edits.groupBy("ct_consign_id").transformWithState(
        NameKeeper(edit_order), "new_name string, vendor_id bigint, customer_id bigint", "Append", "None", known.groupBy("ct_consign_id")
    )
    side = lambda kind, key: F.when(F.col(key).isNotNull(), F.struct(F.lit(kind).alias("ref"), F.col(key).alias("ref_id")))
    sides = F.array_compact(F.array(side("vendor", "vendor_id"), side("customer", "customer_id")))
    rows = changed.select("new_name", F.explode(sides).alias("_t")).select("_t.ref", "_t.ref_id", "new_name")
    conf = renamed.sparkSession.conf
    used = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)  # read when the stream starts
    try:
        return run(rows, folder, keep_batches(folder))
    finally:
        conf.set(PROVIDER, used)


def name_sync_report(shop: Shop, folder: str) -> DataFrame:
    source = StreamShop(shop.spark, shop.sf_dir)
    name_sync(source.consignors_edited, shop.consignors, folder).awaitTermination()
    return latest_rows(shop.spark, folder, ["ref", "ref_id"], NAMES)


def _issued(spark: SparkSession, folder: str, number: int, name: str, schema: str) -> DataFrame:
    """What the batches before ``number`` wrote under ``name``; none if there is nothing yet."""
    if not Folder(spark, folder).exists(name):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/{name}").filter(F.col("batch") < number)


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, *[f"_v.{v}" for v in values])


TILL_ROWS = f"{TILLS}, cash_amount decimal(20,2), day date"
CLOSINGS = "location_id bigint, day date, cash_balance decimal(20,2)"
NO_DAY = "0001-01-01"  # of payments without a time, which come first


def till_balance(payments: DataFrame, methods: DataFrame, openings: DataFrame, folder: str) -> StreamingQuery:
    """Till balance after each till payment, in order of time, whatever the order of arrival.

    A payment that arrives late gets the balance of its own time, and the payments behind it at its till are issued
    again with theirs where they changed; the newest batch of a payment counts (``till_rows``). A batch is one set-based running
    total, so a busy till is spread over tasks. It begins at the earliest new payment of each till: what came before
    is known from the closing balance of the last day before and from that day's own rows, and days before are not
    read, as rows are stored by day. Payments of a till without an opening balance are left out.
    """
    kinds = methods.filter(is_true("till_method")).select("payment_method_id", "cash")
    time = F.struct("process_ts", "customer_payment_id")

    def carry(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = openings.select("location_id")
        new = pin(
            batch.join(kinds, "payment_method_id").join(known, "location_id", "left_semi").select(
                "location_id", "process_ts", "customer_payment_id", "payment_method_id",
                F.when(is_true("cash"), money("amount")).otherwise(money(0)).alias("cash_amount"),
                F.coalesce(F.to_date("process_ts"), F.lit(NO_DAY).cast("date")).alias("day"),
                F.lit(None).cast("decimal(20,2)").alias("issued"),
            )
        )
        starts = new.groupBy("location_id").agg(F.min(time).alias("_from"), F.min("day").alias("_day"))
        first_day = new.agg(F.min("day")).first()[0]
        if first_day is None:
            return
        rows = _issued(spark, folder, number, "rows", TILL_ROWS).filter(F.col("day") >= F.lit(first_day.isoformat()).cast("date"))
        near = pin(_newest(rows, "location_id", "customer_payment_id").join(starts, "location_id").filter(F.col("day") >= F.col("_day")))
        same_day = near.filter((time < F.col("_from")) & (F.col("day") == F.col("_day")))
        same_day = same_day.groupBy("location_id").agg(F.max_by("cash_balance", time).alias("_today"))
        closings = _newest(_issued(spark, folder, number, "closings", CLOSINGS), "location_id", "day").join(starts, "location_id")
        earlier = closings.filter(F.col("day") < F.col("_day")).groupBy("location_id").agg(F.max_by("cash_balance", "day").alias("_earlier"))
        base = openings.select("location_id", "opening_balance").join(starts, "location_id", "left_semi")
        base = base.join(same_day, "location_id", "left").join(earlier, "location_id", "left")
        base = base.select("location_id", F.coalesce("_today", "_earlier", "opening_balance").alias("_base"))
        behind = near.filter(time > F.col("_from")).withColumn("issued", F.col("cash_balance")).select(*new.columns)
        summed = running_totals(new.union(behind), ["process_ts", "customer_payment_id"], {"_added": "cash_amount"}, ["location_id"])
        done = pin(summed.join(base, "location_id").withColumn("cash_balance", money(F.col("_base") + F.col("_added"))))
        changed = done.filter(F.col("issued").isNull() | (F.col("issued") != F.col("cash_balance"))).drop("issued", "_base", "_added")
        ends = done.groupBy("location_id", "day").agg(F.max_by("cash_balance", time).alias("cash_balance"))
        for name, part, by in (("rows", changed, ["day", "batch"]), ("closings", ends, ["batch"])):
            numbered = part.withColumn("batch", F.lit(number))
            numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/{name}")

    return run(payments, folder, carry)


def till_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The newest balance of each till payment."""
    rows = _newest(_issued(spark, folder, 1 << 30, "rows", TILL_ROWS), "location_id", "customer_payment_id")
    return rows.select(*[c.split()[0] for c in TILLS.split(", ")])


def till_balance_report(shop: Shop, folder: str) -> DataFrame:
    source = StreamShop(shop.spark, shop.sf_dir)
    till_balance(source.customer_payments, shop.methods, shop.locations, folder).awaitTermination()
    return till_rows(shop.spark, folder)
