"""Dead letters: wire form, classification and re-drive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.bind import bind
from tidewell.functions.coerce import json_text
from tidewell.model import DEAD_LETTER_FIELDS, DomainSpec

REDRIVEN, EXHAUSTED, PERMANENT = "redriven", "exhausted", "permanent"

# What marks a failure as transient.
TRANSIENT_MARKS = ("fetch failed", "supply response error")


def _open(c: Column) -> Column:
    """Text to variant: JSON where it is JSON, a plain string otherwise, null stays null."""
    return F.coalesce(F.try_parse_json(c), c.cast("variant"))


def to_messages(letters: DataFrame) -> DataFrame:
    """``(key, value)``; key is the id's bytes, null when there is no id."""
    body = F.struct(
        "timestamp",
        "adapter_source",
        "entity_id",
        "action",
        _open(F.col("payload_json")).alias("payload_json"),
        _open(F.col("raw_mail_json")).alias("raw_mail_json"),
        "validation_error",
        "retry_count",
    )
    return letters.select(
        F.col("entity_id").cast("binary").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).cast("binary").alias("value"),
    )


def from_messages(feed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dead letters back from their wire form; payload as JSON text or plain text."""
    opened = F.from_json(F.col("value").cast("string"), DEAD_LETTER_FIELDS)
    read = bind(feed.select(*keep, "value"), "m", opened)
    kinds = {f.name: f.dataType for f in read.schema["m"].dataType.fields}
    return read.select(
        *keep,
        *(
            json_text(F.col(f"m.{n}"), t).alias(n) if n.endswith("_json") else F.col(f"m.{n}")
            for n, t in kinds.items()
        ),
    )


def is_transient(error: Column) -> Column:
    """M3: a failed fetch or an error answer, whatever the letter case."""
    low = F.lower(F.coalesce(error, F.lit("")))
    hit = F.lit(False)
    for mark in TRANSIENT_MARKS:
        hit = hit | low.contains(mark)
    return hit


def classify(letters: DataFrame, spec: DomainSpec) -> DataFrame:
    """M3/M4/M6: add ``outcome``, ``next_retry`` and ``not_before``."""
    again = F.coalesce(F.col("retry_count"), F.lit(0)) + 1
    outcome = (
        F.when(~is_transient(F.col("validation_error")), F.lit(PERMANENT))
        .when(again > spec.max_retries, F.lit(EXHAUSTED))
        .otherwise(F.lit(REDRIVEN))
    )
    return letters.withColumns(
        {
            "outcome": outcome,
            "next_retry": F.when(outcome == REDRIVEN, again),
            "not_before": F.when(
                outcome == REDRIVEN,
                F.timestamp_micros(
                    F.round((F.col("timestamp") + spec.retry_delay_seconds) * 1e6).cast("bigint")
                ),
            ),
        }
    )


def rebuilt_payload(spec: DomainSpec) -> Column:
    """M5: the payload object (``_body``) with the new count, or a minimal event without one."""
    fields = F.expr("try_cast(_body AS MAP<STRING, VARIANT>)")
    minimal = F.create_map(
        F.lit(spec.id_field),
        F.col("entity_id").cast("variant"),
        F.lit("action"),
        F.coalesce("action", F.lit("UPSERT")).cast("variant"),
    )
    base = F.map_filter(F.coalesce(fields, minimal), lambda k, _: k != "_retry_count")
    return F.to_json(
        F.map_concat(base, F.create_map(F.lit("_retry_count"), F.col("next_retry").cast("variant"))),
        {"ignoreNullFields": "false"},
    )


def redriven(classified: DataFrame, spec: DomainSpec, now: Column | None = None) -> DataFrame:
    """The feed messages to send again, only those whose time has come."""
    due = classified.where(F.col("outcome") == REDRIVEN)
    if now is not None:
        due = due.where(F.col("not_before") <= now)
    return bind(due, "_body", F.try_parse_json("payload_json")).select(
        F.col("entity_id").cast("binary").alias("key"),
        rebuilt_payload(spec).cast("binary").alias("value"),
    )


def parked(classified: DataFrame) -> DataFrame:
    """M7: what nobody will retry."""
    return classified.where(F.col("outcome") != REDRIVEN)


def outcome_counts(classified: DataFrame) -> DataFrame:
    """A8."""
    return classified.groupBy("outcome", "retry_count").agg(F.count("*").alias("letters"))
