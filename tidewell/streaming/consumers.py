"""Consumers of ready notices: one query and one checkpoint each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.model import DomainSpec
from tidewell.operators.enrich import are_few
from tidewell.operators.fanout import notices_from_messages
from tidewell.operators.serving import notices_with_rows
from tidewell.sources.feed import TRIGGER_SECONDS
from tidewell.sources.lake import Lake
from tidewell.streaming.ingest import stream_name


def subscribe(
    notices: DataFrame,
    lake: Lake,
    spec: DomainSpec,
    consumer: str,
    out: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Every notice joined to the gold row it announces, written per consumer and batch.

    A notice whose row is gone stays as an error row.  Batches of a new
    checkpoint are numbered after those already there.
    """

    base: dict[str, int] = {}

    def batch(df: DataFrame, batch_id: int) -> None:
        stream = stream_name(df.sparkSession, checkpoint)
        if stream not in base:
            base[stream] = lake.epoch_base(stream, (f"{out}/consumer={consumer}",), "batch_id=")
        told = notices_from_messages(df.select("value", "timestamp"), spec).persist()
        ids = told.select(spec.id_field) if are_few(told, spec.id_field) else None
        rows = notices_with_rows(told, lake.state("gold", ids=ids), spec)
        (
            rows.withColumns(
                {
                    "received_at": F.current_timestamp(),
                    "consumer": F.lit(consumer),
                    "batch_id": F.lit(base[stream] + batch_id).cast("bigint"),
                }
            )
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("consumer", "batch_id")
            .parquet(out)
        )
        told.unpersist()

    writer = (
        notices.writeStream.foreachBatch(batch)
        .queryName(f"{spec.name}-{consumer}")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{TRIGGER_SECONDS} seconds").start()


def received(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)
