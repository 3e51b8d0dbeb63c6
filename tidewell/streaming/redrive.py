"""Dead letters as a stream, and the release of those that are due."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewell.model import DomainSpec
from tidewell.operators import redrive as R
from tidewell.sources import storage
from tidewell.sources.feed import TRIGGER_SECONDS, next_batch, publish
from tidewell.sources.lake import Lake
from tidewell.streaming.ingest import stream_name

#: A letter's place in its feed is its identity.
PLACE = ("partition", "offset")

_JUDGED = (
    "partition INT, `offset` BIGINT, timestamp DOUBLE, adapter_source STRING, entity_id STRING, "
    "action STRING, payload_json STRING, raw_mail_json STRING, validation_error STRING, "
    "retry_count INT, outcome STRING, next_retry INT, not_before TIMESTAMP, epoch_id BIGINT"
)
#: Waiting and released letters lie in buckets of so many seconds of their time.
BUCKET_SECONDS = 60


def bucket_of(moment: Column) -> Column:
    return F.floor(F.unix_micros(moment) / (BUCKET_SECONDS * 1_000_000)).cast("bigint")


def _overwrite_epoch(df: DataFrame, where: str, epoch: int, *within: str) -> None:
    (
        df.withColumn("epoch_id", F.lit(epoch).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("epoch_id", *within)
        .parquet(where)
    )


def run_redrive(
    letters: DataFrame,
    lake: Lake,
    spec: DomainSpec,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Judge each dead letter once; the checkpoint remembers how far it has read.

    Letters to retry go to ``redrive/waiting``, in buckets of the minute they are due, all others to ``redrive/parked``.
    Epochs of a new checkpoint are numbered after those already there, so they
    replace nothing; a letter read again is released once.
    """
    base: dict[str, int] = {}

    def batch(df: DataFrame, batch_id: int) -> None:
        stream = stream_name(df.sparkSession, checkpoint)
        if stream not in base:
            kept = tuple(lake.path("redrive", name) for name in ("waiting", "parked", "judged"))
            base[stream] = lake.epoch_base(f"redrive-{stream}", kept, "epoch_id=")
        epoch = base[stream] + batch_id
        judged = R.classify(R.from_messages(df, PLACE), spec)
        waiting = judged.where(F.col("outcome") == R.REDRIVEN).withColumn("due", bucket_of(F.col("not_before")))
        _overwrite_epoch(waiting, lake.path("redrive", "waiting"), epoch, "due")
        _overwrite_epoch(R.parked(judged), lake.path("redrive", "parked"), epoch)
        # all of the epoch is there now
        storage.make_dirs(df.sparkSession, lake.path("redrive", "judged", f"epoch_id={epoch}"))

    writer = letters.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{TRIGGER_SECONDS} seconds").start()


def judged_letters(spark: SparkSession, lake: Lake, name: str) -> DataFrame:
    """``waiting`` or ``parked`` letters; waiting ones with the bucket they are due in."""
    where = lake.path("redrive", name)
    storage.make_dirs(spark, where)
    return spark.read.schema(_JUDGED + ", due BIGINT" * (name == "waiting")).parquet(where)


def _marks(spark: SparkSession, lake: Lake, before: int) -> tuple[int, int]:
    """Up to where the last release before number ``before`` went: its time's bucket, and the newest epoch it saw."""
    done = [(-1, -1, -1)]
    for name in storage.children(spark, lake.path("redrive", "marks")):
        told = re.fullmatch(r"release=(\d+),due=(-?\d+),epoch=(-?\d+)", name)
        if told and int(told[1]) < before:
            done.append((int(told[1]), int(told[2]), int(told[3])))
    return max(done)[1:]


def due_letters(spark: SparkSession, lake: Lake, now: Column, since: tuple[int, int]) -> DataFrame:
    """The waiting letters whose time has come and that may not have been sent.

    ``since`` tells the bucket and the epoch the last release reached: letters
    of later epochs, whenever they are due, and letters that have become due
    since.  Both are folders of the table, so no others are read.
    """
    bucket, epoch = since
    open_ = (F.col("due") >= bucket) | (F.col("epoch_id") > epoch)
    waiting = judged_letters(spark, lake, "waiting").where((F.col("due") <= bucket_of(now)) & open_)
    return waiting.where(F.col("not_before") <= now).dropDuplicates(list(PLACE))


def _publication(spark: SparkSession, lake: Lake, feed_path: str, release: int) -> int:
    """The number under which a release is published, chosen once."""
    home = lake.path("redrive", "published", f"release={release}")
    known = [int(n[6:]) for n in storage.children(spark, home) if n.startswith("batch=")]
    if not known:
        known = [next_batch(feed_path)]
        storage.make_dirs(spark, f"{home}/batch={known[0]}")
    return min(known)


def release_due(spark: SparkSession, lake: Lake, spec: DomainSpec, feed_path: str, release: int, now: Column) -> None:
    """Send the waiting letters whose time has come and that were not sent yet.

    ``release`` numbers the runs upwards: running one again publishes nothing
    twice.  The feed is written before the ledger, and the ledger before the mark of
    how far the release went, so a crash in between repeats messages rather than losing them.
    """
    ledger = lake.path("redrive", "released")
    storage.make_dirs(spark, ledger)
    (moment,) = spark.range(1).select(F.unix_micros(now)).first()
    now = F.timestamp_micros(F.lit(moment))
    judged = storage.children(spark, lake.path("redrive", "judged"))
    newest = max((int(n[9:]) for n in judged if n.startswith("epoch_id=")), default=-1)
    due = storage.cut_lineage(due_letters(spark, lake, now, _marks(spark, lake, release)).where(F.col("epoch_id") <= newest).drop("epoch_id"))
    first, last = due.agg(F.min("due"), F.max("due")).first()
    if first is not None:
        known = T.StructType.fromDDL("partition INT, `offset` BIGINT, epoch_id BIGINT, due BIGINT")
        sent = spark.read.schema(known).parquet(ledger).where(F.col("due").between(first, last))
        sent = sent.where(F.col("epoch_id") != F.lit(release))
        # what is due is decided once, so the feed and the ledger cannot disagree
        chosen = storage.cut_lineage(due.join(sent.select(*PLACE), list(PLACE), "left_anti"))
        publish(R.redriven(chosen, spec), feed_path, _publication(spark, lake, feed_path, release))
        _overwrite_epoch(chosen.select(*PLACE, "due"), ledger, release, "due")
    reached = moment // (BUCKET_SECONDS * 1_000_000)
    storage.make_dirs(spark, lake.path("redrive", "marks", f"release={release},due={reached},epoch={newest}"))
