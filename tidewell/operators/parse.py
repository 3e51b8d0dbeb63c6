"""Change feed -> typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import payload as P
from tidewell.functions.bind import bind
from tidewell.functions.coerce import is_blank
from tidewell.model import DomainSpec

# Routing messages.
BAD_JSON = "invalid event payload json"


def missing_id(spec: DomainSpec) -> str:
    return f"event {spec.id_field} is missing"


def parse_feed(feed: DataFrame, spec: DomainSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per message; ``parse_error`` is null for usable events.

    ``keep`` names further feed columns to carry along (an epoch, say).  The
    arrival order is the feed's own (partition, offset).
    """
    raw = F.col("value").cast("string")
    text = feed.select(*keep, "partition", "offset", raw.alias("payload_json"))
    opened = bind(text, "_all", P.envelope(F.col("payload_json")))
    whole = F.col("_all")
    ident = F.col("_id")
    read = opened.select(
        *keep,
        "partition",
        "offset",
        P.field_text(whole, spec.id_field).alias("_id"),
        P.action(whole).alias("action"),
        P.version(whole).alias("event_version"),
        P.moment(whole, "source_updated_at").alias("source_updated_at"),
        P.moment(whole, "occurred_at").alias("occurred_at"),
        "payload_json",
        P.is_one_object(F.col("payload_json"), whole).alias("_good"),
    )
    named = read.withColumn(
        "parse_error",
        F.when(~F.col("_good"), F.lit(BAD_JSON)).when(is_blank(ident), F.lit(missing_id(spec))),
    )
    return named.select(
        *keep,
        "partition",
        "offset",
        F.when(F.col("parse_error").isNull(), ident).alias(spec.id_field),
        F.when(F.col("_good"), F.col("action")).otherwise(F.lit("UPSERT")).alias("action"),
        F.when(F.col("_good"), F.col("event_version")).otherwise(F.lit(0)).alias("event_version"),
        F.when(F.col("_good"), F.col("source_updated_at")).alias("source_updated_at"),
        F.when(F.col("_good"), F.col("occurred_at")).alias("occurred_at"),
        "payload_json",
        "parse_error",
    )


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parse_error").isNull()).drop("parse_error")


def unusable(parsed: DataFrame) -> DataFrame:
    """P2/P3 rejects; their action always reads UPSERT and their id is null."""
    return parsed.where(F.col("parse_error").isNotNull())


def deletes(events: DataFrame) -> DataFrame:
    """P7."""
    return events.where(F.col("action") == "DELETE")


def upserts(events: DataFrame) -> DataFrame:
    return events.where(F.col("action") == "UPSERT")


def delete_ids(events: DataFrame, spec: DomainSpec) -> DataFrame:
    """A2/L1: the distinct ids to delete, in order."""
    return deletes(events).select(spec.id_field).distinct().orderBy(spec.id_field)
