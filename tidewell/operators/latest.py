"""Latest event per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import DomainSpec

ORDER_FIELDS = ("event_version", "source_updated_at", "occurred_at", "partition", "offset")


def order_key(fields: tuple[str, ...] = ORDER_FIELDS) -> Column:
    """Highest wins field by field; nulls rank lowest; later arrival breaks ties."""
    return F.struct(*(F.col(f) for f in fields))


def latest_per_key(events: DataFrame, spec: DomainSpec, by: tuple[str, ...] = ()) -> DataFrame:
    """One event per id (and per ``by`` group).

    An aggregate rather than a ranking window: each map task sends at most one
    row per key, so a key holding a third of the feed costs no more than any other.
    Its rows are sorted by key, and only the first key is compared by its leading bytes; so the id comes first.
    """
    keys = [spec.id_field, *by]
    rest = [c for c in events.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order_key())
    return (
        events.groupBy(*keys).agg(best.alias("_best")).select(*keys, *(f"_best.{c}" for c in rest))
    ).select(*events.columns)
