"""Session set-up shared by tests, benchmarks and the driver contract."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators count on. Joins are left to the planner: a side is broadcast
# only when its measured size is under spark.sql.autoBroadcastJoinThreshold, and a sort-merge join
# whose key is hot is split by AQE, even where the split costs one more exchange for a later
# aggregation that would otherwise have reused the join's partitioning.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Bytes of shuffled rows that AQE packs into a task or leaves in one, at most. They are compressed: ids that
# follow one another take a fortieth of their room in memory, so Spark's own 64 and 256 MB may be gigabytes in a sort.
AT_MOST = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 4 << 20,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 32 << 20,
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made by someone else; sizes are lowered, never raised."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in AT_MOST.items():
        if in_bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


# Input bytes per shuffle partition before AQE packs small ones: few, as long as that gives no more than so many partitions.
BYTES_PER_PARTITION, MANY, MOST_BYTES = 8 << 20, 8000, 256 << 20
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """Raise the number of shuffle partitions to suit the size of the input files, once per session and folder.

    Only file sizes are read. AQE can pack partitions but not split those of an aggregation, so a large
    input needs many to begin with.
    """
    done = f"spark.shelfbook.sized.{folder}"
    if spark.conf.get(done, None):
        return
    spark.conf.set(done, "true")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    size = listing.agg(F.sum("length")).first()[0] or 0
    wanted = max(min(-(-size // BYTES_PER_PARTITION), MANY), -(-size // MOST_BYTES))
    in_force = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL, None) or 0))
    if wanted > in_force:
        spark.conf.set(INITIAL, str(wanted))


def local_session(cores: int | str = 8, app: str = "shelfbook") -> SparkSession:
    """A small local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


# Used in local mode only, where the session names no checkpoint folder.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the cluster's checkpoint folder, or one for local mode where none is set."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    return LOCAL_FOLDER


def scratch_folder(spark: SparkSession) -> str:
    """A new path under the shared folder that is removed when the application ends."""
    path = f"{shared_folder(spark)}/shelfbook-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def pin(df: DataFrame, *by: str) -> DataFrame:
    """Write the frame to the shared folder once, as compressed Parquet, so that every use sees the same rows.

    The files survive the loss of executors and are removed when the application ends. They lie in folders ``by`` columns.
    """
    path = scratch_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What a query shuffled goes as soon as it has ended, not when the driver happens to collect garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def pinned(df: DataFrame) -> Iterator[DataFrame]:
    """``pin`` for a while: what the write shuffles goes when it has ended, the files when the caller is done with them."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    try:
        with settings(spark, FREED):
            df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
