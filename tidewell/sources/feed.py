"""Change feeds: reading, admission, publishing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import FEED_SCHEMA
from tidewell.sources import publications

# Stream defaults.
MAX_PER_TRIGGER = 5000
TRIGGER_SECONDS = 5
#: Partitions of a feed kept in folders.
PARTITIONS = 256


def stream_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_per_trigger: int = MAX_PER_TRIGGER,
    **options: str,
) -> DataFrame:
    """S1 from a broker; needs the connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "false")
        .option("maxOffsetsPerTrigger", max_per_trigger)
    )
    return reader.options(**options).load().select(*FEED_SCHEMA.names)


def stream_feed(spark: SparkSession, path: str, max_per_trigger: int = MAX_PER_TRIGGER) -> DataFrame:
    """S1/S4 from the publications in a folder: at most so many events a batch, whatever the sizes of files."""
    publications.register(spark)
    reader = spark.readStream.format(publications.FORMAT).option("path", path)
    return reader.option("maxEvents", str(max_per_trigger)).load()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """All complete publications of a folder."""
    publications.register(spark)
    return spark.read.format(publications.FORMAT).option("path", path).load()


def stream_folder(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """S1/S14 from a folder of feed files, every sub-folder included."""
    reader = spark.readStream.schema(FEED_SCHEMA).option("recursiveFileLookup", "true")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def as_feed(messages: DataFrame, batch: int | None = None) -> DataFrame:
    """Complete ``(key, value)`` rows to the feed contract.

    Like a keyed broker: messages of one key share a partition, and offsets
    grow with the batch number (the clock by default), so of two publications
    of a key the later one sorts later.  Offsets are unique within a batch;
    keyless messages go by their content.
    """
    number = int(time.time()) if batch is None else batch
    place = F.coalesce(F.xxhash64("key"), F.xxhash64("value"))
    # 2**31 batches of 2**32 messages; the id holds the task above 33 bits and the row below
    row = F.monotonically_increasing_id()
    task, within = F.shiftright(row, 33), row.bitwiseAND((1 << 33) - 1)
    return messages.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.pmod(place, F.lit(PARTITIONS)).cast("int").alias("partition"),
        (F.lit(number).cast("bigint") * F.lit(1 << 32) + task * F.lit(1 << 20) + within).alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )


def next_batch(path: str) -> int:
    """A number for the next publication: the clock's, but above all that are there."""
    return max(int(time.time()), publications.Feed(path).newest() + 1)


def publish(messages: DataFrame, path: str, batch: int | None = None) -> int:
    """Write messages as one publication of a feed and return its number.

    Publishing a number again adds nothing, so a step that was interrupted can
    be run again.  Without a number the feed should have one writer.
    """
    publications.register(messages.sparkSession)
    number = next_batch(path) if batch is None else batch
    writer = as_feed(messages, number).write.format(publications.FORMAT).mode("append")
    writer.option("path", path).option("batch", str(number)).save()
    return number


def list_records(source: DataFrame) -> DataFrame:
    """Every source record, unfiltered."""
    return source.select("lookup_id", "record.*")
