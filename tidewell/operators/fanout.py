"""One event to many subscribers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import DomainSpec


def event_messages(changes: DataFrame, spec: DomainSpec) -> DataFrame:
    """``(id, action)`` rows to feed messages; a missing id becomes 8 hex characters."""
    ident = F.coalesce(F.col(spec.id_field), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))
    body = F.struct(ident.alias(spec.id_field), F.col("action"))
    return changes.select(
        F.lit(None).cast("binary").alias("key"), F.to_json(body).cast("binary").alias("value")
    )


def fan_out(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    """One identical copy per topic, made where the row is, without a join."""
    return messages.withColumn("topic", F.explode(F.array(*(F.lit(t) for t in topics))))


def subscription(fanned: DataFrame, topic: str) -> DataFrame:
    """What one subscriber reads."""
    return fanned.where(F.col("topic") == topic).drop("topic")


def notices_from_messages(messages: DataFrame, spec: DomainSpec) -> DataFrame:
    """Notices as a consumer reads them; messages that are no JSON object are skipped."""
    body = F.try_parse_json(F.col("value").cast("string"))
    return (
        messages.withColumn("_b", body)
        .where(F.schema_of_variant("_b").startswith("OBJECT"))
        .select(
            F.try_variant_get("_b", f"$.{spec.id_field}", "string").alias(spec.id_field),
            F.try_variant_get("_b", "$.status", "string").alias("status"),
        )
    )
