"""One batch of the feed from messages to outputs; the same code serves batch and stream.

``judge``  feed + source -> one row per surviving message with its verdict so far
``settle`` (operators.outcomes) adds the version check
``process`` runs both and hands out the six outputs as lazy frames
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.envelope import FieldKey, protected
from tidewell.model import DomainSpec
from tidewell.operators import enrich, outcomes
from tidewell.operators.latest import latest_per_key
from tidewell.operators.parse import parse_feed
from tidewell.sources.storage import cut_lineage


@dataclass(frozen=True)
class Outputs:
    settled: DataFrame
    accepted: DataFrame
    deletes: DataFrame
    quarantine: DataFrame
    dead_letters: DataFrame
    ready: DataFrame
    metrics: DataFrame


def survivors(feed: DataFrame, spec: DomainSpec) -> DataFrame:
    """Parse, then keep the latest event per id; every unusable message survives as itself.

    Unusable messages get a group of their own in the same aggregate, so the
    feed is read and parsed once.
    """
    parsed = parse_feed(feed, spec)
    alone = F.when(F.col("parse_error").isNotNull(), F.struct("partition", "offset"))
    return latest_per_key(parsed.withColumn("_alone", alone), spec, by=("_alone",)).drop("_alone")


def judge(
    events: DataFrame,
    source: DataFrame,
    spec: DomainSpec,
    key: FieldKey,
    few: bool = False,
    seal_quarantine: bool = True,
) -> DataFrame:
    """Deletes pass as they are; upserts are looked up, validated, cleaned, projected, sealed."""
    looked_up = F.col("parse_error").isNull() & (F.col("action") == "UPSERT")
    asked = events.where(looked_up)
    found = enrich.lookup(asked, source, spec, few)
    checked = enrich.clean_record(enrich.validate(found, spec), spec)
    failed = F.coalesce("lookup_error", F.when(F.col("lookup_error").isNull(), F.col("rule_error")), "clean_error")
    record = enrich.record_of(checked)
    row_id = enrich.canonical_id(record, spec, F.col(spec.id_field))
    # sealed once, for the row and for the quarantined record alike
    sealed = checked.withColumns(
        {"error": failed, **{f"_{n}_enc": protected(record.text(n), key) for n in spec.personal}}
    )
    values = [
        F.col(f"_{n}_enc").alias(f"{n}_enc")
        if n in spec.personal
        else enrich.canonical_value(record, spec, n).alias(n)
        for n, _ in spec.fields
    ]
    row = F.struct(
        row_id.alias(spec.id_field),
        *values,
        *spec.event_fields,
        F.current_timestamp().alias("ingested_at"),
    )
    answered_error = F.to_json(F.struct(F.regexp_replace("lookup_error", f"^{enrich.RESPONSE_ERROR}", "").alias("error")))
    kept_record = F.when(
        F.col("lookup_error").startswith(enrich.RESPONSE_ERROR), answered_error
    ).when(
        F.col("lookup_error").isNull() & F.col("error").isNotNull(),
        F.coalesce(enrich.kept_record(checked, spec, seal_quarantine), F.lit("{}")),
    )
    passed = F.col("error").isNull()
    upserts = sealed.select(
        "partition",
        "offset",
        F.col(spec.id_field).alias("entity_id"),
        F.when(passed, row_id).alias("row_id"),
        "action",
        *spec.event_fields,
        "payload_json",
        kept_record.alias("record_json"),
        "error",
        F.when(passed, row).alias("row"),
        F.lit(True).alias("deduped"),
    )
    others = events.where(~looked_up).select(
        "partition",
        "offset",
        F.col(spec.id_field).alias("entity_id"),
        F.when(F.col("parse_error").isNull(), F.col(spec.id_field)).alias("row_id"),
        F.when(F.col("parse_error").isNull(), F.col("action")).otherwise(F.lit("UPSERT")).alias("action"),
        *spec.event_fields,
        "payload_json",
        F.lit(None).cast("string").alias("record_json"),
        F.col("parse_error").alias("error"),
        F.lit(None).cast(upserts.schema["row"].dataType).alias("row"),
        F.col("parse_error").isNull().alias("deduped"),
    )
    return upserts.unionByName(others)


def outputs_of(settled: DataFrame, spec: DomainSpec) -> Outputs:
    quarantine = outcomes.quarantine_rows(settled, spec)
    return Outputs(
        settled=settled,
        accepted=outcomes.accepted_rows(settled),
        deletes=outcomes.deleted_ids(settled, spec),
        quarantine=quarantine,
        dead_letters=outcomes.dead_letters(quarantine, spec),
        ready=outcomes.ready_notices(settled, spec),
        metrics=outcomes.metrics(settled),
    )


def process(
    spec: DomainSpec,
    feed: DataFrame,
    source: DataFrame,
    versions: DataFrame,
    key: FieldKey,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> Outputs:
    """The whole batch; the outputs are frames over one written table of verdicts.

    ``materialize`` is applied to the surviving events, so that the feed is read
    once, and to the verdicts, which fixes the drawn nonces and spares every
    output a second look at the source.
    """
    events = materialize(survivors(feed, spec))
    judged = materialize(judge(events, source, spec, key, enrich.are_few(events, spec.id_field)))
    return outputs_of(outcomes.settle(judged, versions, spec), spec)
