"""Reading the gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.coerce import iso_text, text
from tidewell.model import DomainSpec
from tidewell.operators import scan


def serve_view(gold: DataFrame, spec: DomainSpec) -> DataFrame:
    """The served document; the stored time is not served."""
    inner = [text(F.col(spec.id_field)).alias("id")]
    for f in spec.table_schema.fields:
        if f.name in (spec.id_field, "ingested_at"):
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            out = text(c)
        elif isinstance(f.dataType, T.BooleanType):
            out = F.coalesce(c, F.lit(False))
        elif isinstance(f.dataType, T.TimestampType):
            out = iso_text(c)
        else:
            out = F.coalesce(c, F.lit(0).cast(f.dataType))
        inner.append(out.alias(f.name))
    return gold.select(
        text(F.col(spec.id_field)).alias(spec.id_field),
        F.struct(*inner).alias(spec.name),
        F.lit(f"local.gold.{spec.name}").alias("source"),
    )


def serve_lookup(gold: DataFrame, spec: DomainSpec, entity_id: str) -> DataFrame:
    """One document or none; the equality reaches the file scan."""
    hit = gold.where(F.col(spec.id_field) == F.lit(entity_id))
    return serve_view(hit.orderBy(F.desc_nulls_last("event_version")).limit(1), spec)


def notices_with_rows(
    ready: DataFrame, gold: DataFrame, spec: DomainSpec
) -> DataFrame:
    """What a consumer gets for each notice; a miss stays as an error row.

    Give ``Lake.state`` the ids of the notices, so that ``gold`` holds only theirs.
    """
    rows = gold.withColumn("_hit", F.lit(True))
    miss = F.concat(F.lit(f"{spec.id_field} not found: "), F.coalesce(spec.id_field, F.lit("")))
    return (
        ready.join(rows, spec.id_field, "left")
        .withColumn("error", F.when(F.col("_hit").isNull(), miss))
        .drop("_hit")
    )


def notices_as_of(ready: DataFrame, log: DataFrame, spec: DomainSpec, epoch: str = "epoch_id") -> DataFrame:
    """J6 for late readers: each notice with the row as it was when the notice was sent.

    ``ready`` carries the epoch of each notice, ``log`` the changes of a layer
    (``Lake.log``): schema S, ``op`` and the epoch.  The last change of the id up to that
    epoch counts; a delete, or no change at all, is an error row.  The search moves ids and
    epochs only; a row meets its notice by both.
    """
    ident = spec.id_field
    asked = ready.select(ident).where(F.col(ident).isNotNull()).distinct()
    mine = log.join(asked, ident, "left_semi")
    found = scan.as_of(ready.where(F.col(ident).isNotNull()), mine, ident, epoch)
    rest = [c for c in log.columns if c not in (ident, epoch, "span")]
    # inside one epoch deletes run before upserts, so the upsert is the later one
    last = mine.groupBy(ident, F.col(epoch).alias("found")).agg(F.max_by(F.struct(*rest), F.col("op") == "U").alias("_r"))
    met = ready.join(found, [ident, epoch], "left").join(last, [ident, "found"], "left")
    live = F.coalesce(F.col("_r.op") == "U", F.lit(False))
    miss = F.concat(F.lit(f"{ident} not found: "), F.coalesce(ident, F.lit("")))
    return met.select(
        *ready.columns,
        *(F.when(live, F.col(f"_r.{c}")).alias(c) for c in rest if c != "op"),
        F.when(~live, miss).alias("error"),
    )


def _allowed(
    requests: DataFrame, credentials: DataFrame, memberships: DataFrame, routes: DataFrame
) -> DataFrame:
    """The (key, route) pairs among the requests that some group permits.

    Starts from the pairs that were asked for, so a group with many members and
    many routes is never multiplied out.
    """
    asked = requests.where(F.col("api_key").isNotNull()).select("api_key", "route").distinct()
    groups = asked.join(credentials, "api_key").join(memberships, "consumer")
    return (
        groups.join(routes, ["route", "member_group"], "left_semi")
        .select("api_key", "route")
        .distinct()
    )


def entitled(
    requests: DataFrame, credentials: DataFrame, memberships: DataFrame, routes: DataFrame
) -> DataFrame:
    """Requests whose key belongs to a consumer in a group the route allows.

    ``requests(api_key, route, ...)``, ``credentials(api_key, consumer)``,
    ``memberships(consumer, member_group)``, ``routes(route, member_group)``.
    A request without a known key never matches.
    """
    allowed = _allowed(requests, credentials, memberships, routes)
    return requests.join(allowed, ["api_key", "route"], "left_semi")


def refused(
    requests: DataFrame, credentials: DataFrame, memberships: DataFrame, routes: DataFrame
) -> DataFrame:
    """J7, the other side."""
    allowed = _allowed(requests, credentials, memberships, routes)
    return requests.join(allowed, ["api_key", "route"], "left_anti")
