"""Whole histories in one pass instead of epoch by epoch (W3 over A1, J1, V*, T8, P9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import DomainSpec
from tidewell.operators import enrich
from tidewell.operators.latest import latest_per_key
from tidewell.operators.parse import parse_feed, usable
from tidewell.operators.versions import final_state, fold_versions, stale_rows
from tidewell.sources.storage import cut_lineage


def epoch_winners(feed: DataFrame, spec: DomainSpec, epoch: str = "epoch_id") -> DataFrame:
    """A1 per epoch over a feed that carries an epoch column; payloads stay behind, so none is shuffled."""
    events = usable(parse_feed(feed, spec, keep=(epoch,))).drop("payload_json")
    return latest_per_key(events, spec, by=(epoch,))


def good_records(source: DataFrame, spec: DomainSpec) -> DataFrame:
    """Source rows (id, record, whatever else they carry) that pass every check, cleaned."""
    named = source.withColumnRenamed("lookup_id", spec.id_field).withColumn(
        "lookup_error", enrich.source_error(source)
    )
    judged = enrich.clean_record(enrich.validate(named, spec), spec)
    return judged.where(F.coalesce("lookup_error", "rule_error", "clean_error").isNull())


def renamed_records(source: DataFrame, spec: DomainSpec) -> DataFrame:
    """Records whose own id is not the id they are looked up by; only id columns are read.

    The plans below need this to be empty: with one lake row fed by several
    lookup ids an epoch can hold a delete and an upsert of the same row, and
    which of them stands depends on the epochs before.  Run such a source epoch
    by epoch (``streaming.ingest``), which handles it.
    """
    own = enrich.canonical_id(enrich.record_of(source), spec, F.col("lookup_id"))
    return source.where(own != F.col("lookup_id")).select("lookup_id", own.alias(spec.id_field))


def gold_state(
    feed: DataFrame,
    source: DataFrame,
    spec: DomainSpec,
    epoch: str = "epoch_id",
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Schema C rows the lake ends with after all epochs.

    A record's verdict depends on the record alone, so an id with a bad record
    can never own a row and its other events need no judging.  The history is
    therefore folded first, on the small events (written once, so the feed is
    parsed once), and the source is read once, for the surviving ids only.
    """
    winners = epoch_winners(feed, spec, epoch).select(
        epoch, spec.id_field, "action", *spec.event_fields
    )
    last = final_state(materialize(winners), spec, epoch)
    few = enrich.are_few(last, spec.id_field)
    wanted = last.withColumnRenamed(spec.id_field, "lookup_id")
    # few survivors go to the source; its bodies are shuffled only for many
    found = source.join(F.broadcast(wanted) if few else wanted, "lookup_id")
    return enrich.to_canonical(good_records(found, spec), spec)


def stale_events(
    feed: DataFrame,
    source: DataFrame,
    spec: DomainSpec,
    epoch: str = "epoch_id",
    block: int | None = None,
) -> DataFrame:
    """Every upsert of the history the version check rejects, with its message.

    The versions an id meets do not depend on other ids, so the history is
    folded as if all records were good and the ids of bad ones are dropped
    after; only records of ids with a stale event are judged.
    """
    stale = cut_lineage(stale_rows(fold_versions(epoch_winners(feed, spec, epoch), spec, epoch, block)))
    ids = stale.select(spec.id_field).distinct()
    asked = enrich.narrow_source(source, ids, spec.id_field, enrich.are_few(ids, spec.id_field))
    return stale.join(good_records(asked, spec).select(spec.id_field), spec.id_field, "left_semi")
