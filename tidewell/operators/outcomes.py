"""From judged events to the outputs of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import payload as P
from tidewell.model import DomainSpec
from tidewell.operators.latest import order_key
from tidewell.operators.versions import is_stale, stale_message

ACCEPTED, DELETED, QUARANTINED, SUPERSEDED = "accepted", "deleted", "quarantined", "superseded"


def settle(judged: DataFrame, versions: DataFrame, spec: DomainSpec, few: bool = False) -> DataFrame:
    """J2/J3/D2 on the judged events: add ``outcome`` and the final ``error``.

    ``judged`` has ``row_id`` (the canonical id) for every row that may change
    the lake.  One small frame per canonical id carries both the stored version
    and the best incoming order key, so the bodies meet it in a single join.
    """
    checks_deletes = spec.delete_policy == "versioned"
    live = F.col("error").isNull() & F.col("row_id").isNotNull()
    checked = live if checks_deletes else live & (F.col("action") == "UPSERT")
    slim = judged.where(checked).select(
        "row_id", "action", "event_version", "source_updated_at", "occurred_at", "partition", "offset"
    )
    tops = slim.groupBy("row_id").agg(F.max(order_key()).alias("_top"))
    stored = versions.toDF("row_id", "_version").where(F.col("_version").isNotNull())
    wanted = tops.select("row_id")
    stored = (
        stored.join(F.broadcast(wanted) if few else wanted, "row_id", "left_semi")
        .groupBy("row_id")
        .agg(F.max("_version").alias("current_version"))
    )
    per_id = tops.join(stored, "row_id", "left").withColumn("_spread", F.lit(0))
    # rows without an id match nothing; the second key keeps them from meeting in one task
    spread = F.when(F.col("row_id").isNull(), F.hash("partition", "offset")).otherwise(F.lit(0))
    met = judged.withColumn("_spread", spread).join(
        F.broadcast(per_id) if few else per_id, ["row_id", "_spread"], "left"
    )

    stale = checked & is_stale(F.col("event_version"), F.col("current_version"))
    beaten = checked & (order_key() < F.col("_top"))
    if not checks_deletes:
        beaten = beaten & (F.col("action") == "UPSERT")
    outcome = (
        F.when(F.col("error").isNotNull() | stale, F.lit(QUARANTINED))
        .when(beaten, F.lit(SUPERSEDED))
        .when(F.col("action") == "DELETE", F.lit(DELETED))
        .otherwise(F.lit(ACCEPTED))
    )
    return met.select(
        *judged.columns,
        "current_version",
        stale.alias("is_stale"),
        outcome.alias("outcome"),
    ).withColumn(
        "error",
        F.when(
            F.col("is_stale"), stale_message(F.col("event_version"), F.col("current_version"))
        ).otherwise(F.col("error")),
    )


def accepted_rows(settled: DataFrame) -> DataFrame:
    """Schema S rows to store."""
    return settled.where(F.col("outcome") == ACCEPTED).select("row.*")


def changes(settled: DataFrame, spec: DomainSpec) -> DataFrame:
    """What the epoch does to the lake, in one pass: schema S plus ``op`` (``U`` or ``D``)."""
    gone = F.col("outcome") == DELETED
    values = []
    for name in spec.table_schema.names:
        c = F.col(f"row.{name}")
        if name == spec.id_field:
            c = F.when(gone, F.col("entity_id")).otherwise(c)
        elif name == "event_version":
            c = F.when(gone, F.col("event_version")).otherwise(c)
        values.append(c.alias(name))
    return settled.where(F.col("outcome").isin(ACCEPTED, DELETED)).select(
        *values, F.when(gone, F.lit("D")).otherwise(F.lit("U")).alias("op")
    )


def deleted_ids(settled: DataFrame, spec: DomainSpec) -> DataFrame:
    """A2: distinct ids to remove."""
    return (
        settled.where(F.col("outcome") == DELETED)
        .select(F.col("entity_id").alias(spec.id_field))
        .distinct()
    )


def quarantine_rows(settled: DataFrame, spec: DomainSpec, at: Column | None = None) -> DataFrame:
    """Schema X.  The action always reads UPSERT; stale rows carry no payload."""
    stale = F.col("is_stale")
    return settled.where(F.col("outcome") == QUARANTINED).select(
        F.when(stale, F.col("row_id")).otherwise(F.col("entity_id")).alias(spec.id_field),
        F.lit("UPSERT").alias("action"),
        F.when(~stale, F.col("payload_json")).alias("payload_json"),
        F.when(~stale, F.col("record_json")).alias("raw_mail_json"),
        F.col("error").alias("validation_error"),
        (F.current_timestamp() if at is None else at).alias("quarantined_at"),
    )


def dead_letters(quarantine: DataFrame, spec: DomainSpec) -> DataFrame:
    """Struct Q; the retry count is lifted from the payload."""
    return quarantine.select(
        (F.unix_micros("quarantined_at") / F.lit(1e6)).alias("timestamp"),
        F.lit(spec.source_label).alias("adapter_source"),
        F.col(spec.id_field).alias("entity_id"),
        "action",
        "payload_json",
        "raw_mail_json",
        "validation_error",
        P.retry_count(F.col("payload_json")).alias("retry_count"),
    )


def ready_notices(settled: DataFrame, spec: DomainSpec) -> DataFrame:
    """Struct R for deletes and accepted rows only."""
    told = settled.where(F.col("outcome").isin(ACCEPTED, DELETED))
    status = F.when(F.col("outcome") == ACCEPTED, F.lit("ready")).otherwise(F.lit("deleted"))
    return told.select(F.col("entity_id").alias(spec.id_field), status.alias("status"))


def metrics(settled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A3: events after dedupe, accepted, deleted ids, quarantined (stale included)."""
    outcome = F.col("outcome")
    return settled.groupBy(*by).agg(
        F.count_if(F.col("deduped")).alias("events"),
        F.count_if(outcome == ACCEPTED).alias("accepted"),
        F.count_if(outcome == DELETED).alias("deleted"),
        F.count_if(outcome == QUARANTINED).alias("quarantined"),
    )
