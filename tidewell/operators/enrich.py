"""Claim check: event -> full record, then validate, clean and project (J1, V*, T8, P9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as X
from tidewell.functions.coerce import is_empty, is_json_true, iso_timestamp, text
from tidewell.functions.rules import Record, first_failure
from tidewell.model import DomainSpec

#: Ids, and the few numbers beside them, are sent to every executor only up to this measured size.
BROADCAST_BYTES = 32 << 20
_ROW_BYTES = 64


def measure(rows: DataFrame, id_field: str) -> tuple[int, bool]:
    """How many rows there are, and whether their ids, with up to five numbers beside each, are small enough to broadcast."""
    size = F.sum(F.coalesce(F.octet_length(F.col(id_field).cast("string")), F.lit(0)) + _ROW_BYTES)
    n, size = rows.agg(F.count("*"), size).first()
    return n, (size or 0) <= BROADCAST_BYTES


def are_few(rows: DataFrame, id_field: str) -> bool:
    return measure(rows, id_field)[1]

# Message prefixes.
FETCH_FAILED = "fetch failed: "
RESPONSE_ERROR = "supply response error: "
NOT_FOUND = "not found"


def source_from_responses(responses: DataFrame, spec: DomainSpec) -> DataFrame:
    """Turn ``(lookup_id, response JSON text)`` into the source contract.

    A response is ``{"<domain>": {...}}`` or ``{"error": ...}``; anything that
    is not such an object counts as a failed fetch.
    """
    flags = [n for n, t in spec.fields if t == "boolean"]
    inner = ", ".join(
        f"{n}: {'VARIANT' if n in flags else 'STRING'}"
        for n in dict.fromkeys([*spec.id_candidates, *(n for n, _ in spec.fields)])
    )
    shape = f"{spec.name} STRUCT<{inner}>, error STRING"
    read = responses.select("lookup_id", "response", F.from_json("response", shape).alias("_r"))
    kind = F.schema_of_variant(F.try_parse_json("response"))
    return read.select(
        "lookup_id",
        F.col(f"_r.{spec.name}").alias("record"),
        F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.lit("unreadable response")).alias(
            "fetch_error"
        ),
        F.when(~is_empty(F.col("_r.error")), F.col("_r.error")).alias("response_error"),
    )


def narrow_source(source: DataFrame, ids: DataFrame, id_field: str, few: bool) -> DataFrame:
    """Keep the source rows some event asks for.

    When the ids are few, they travel to the source and no record body is
    shuffled; otherwise both sides are hashed on the id.
    """
    wanted = ids.select(F.col(id_field).alias("lookup_id"))
    if few:
        wanted = F.broadcast(wanted)
    return source.join(wanted, "lookup_id", "left_semi")


def lookup(
    events: DataFrame, source: DataFrame, spec: DomainSpec, few: bool = False
) -> DataFrame:
    """Every upsert with its ``record`` or a ``lookup_error``.  A miss is an error row.

    Pass ``few`` when the events are written or cached and measured
    (``are_few``): their ids then filter the source where it lies.  Without it
    this is one plain join.
    """
    if few:
        source = narrow_source(source, events, spec.id_field, few)
    found = source.select(
        F.col("lookup_id").alias(spec.id_field),
        "record",
        source_error(source).alias("_error"),
        F.lit(True).alias("_hit"),
    )
    missed = F.when(F.col("_hit").isNull(), F.lit(RESPONSE_ERROR + NOT_FOUND))
    return (
        events.join(found, spec.id_field, "left")
        .withColumn("lookup_error", F.coalesce("_error", missed))
        .drop("_error", "_hit")
    )


def source_error(source: DataFrame) -> Column:
    """The message of a failed fetch or an error answer, null for a good row."""
    error = F.lit(None).cast("string")
    if "response_error" in source.columns:
        answer = F.col("response_error")
        error = F.when(~is_empty(answer), F.concat(F.lit(RESPONSE_ERROR), answer))
    if "fetch_error" in source.columns:
        error = F.coalesce(F.concat(F.lit(FETCH_FAILED), "fetch_error"), error)
    return error


def record_of(frame: DataFrame) -> Record:
    return Record(frame.schema["record"].dataType)


def validate(frame: DataFrame, spec: DomainSpec) -> DataFrame:
    """Add ``rule_error`` with the first broken rule of the raw record."""
    return frame.withColumn("rule_error", first_failure(spec.rules(record_of(frame))))


def clean_record(frame: DataFrame, spec: DomainSpec) -> DataFrame:
    """Add ``clean_<field>`` and ``clean_error``.

    A field with policy ``if_tagged`` is touched only when it holds a tag.
    Records that already failed are not cleaned.
    """
    record = record_of(frame)
    failed = F.lit(False)
    for name in ("lookup_error", "rule_error"):
        if name in frame.columns:
            failed = failed | F.col(name).isNotNull()
    wanted = {}
    for name, policy in spec.cleaned:
        value = record.text(name)
        need = ~failed if policy == "always" else ~failed & X.has_tag(value)
        wanted[f"clean_{name}"] = F.when(need, value)
    asked = {f"_had_{n}": wanted[f"clean_{n}"].isNotNull() for n, _ in spec.cleaned}
    out = frame.withColumns({**wanted, **asked})
    out = X.refine(out, wanted.keys()) if wanted else out
    problems = [
        F.when(F.col(f"clean_{n}") == "", F.lit(f"{n} is empty after refinement")).when(
            F.col(f"clean_{n}").isNull() & F.col(f"_had_{n}"), F.lit(f"{n} cannot be read")
        )
        for n, _ in spec.cleaned
    ]
    return out.withColumn(
        "clean_error", first_failure(problems) if problems else F.lit(None).cast("string")
    ).drop(*asked)


def canonical_value(record: Record, spec: DomainSpec, name: str) -> Column:
    """P9 for one field, from the cleaned text where there is one."""
    kind = spec.field_type(name)
    if isinstance(kind, T.StringType):
        if name in dict(spec.cleaned):
            return F.coalesce(F.col(f"clean_{name}"), text(record.text(name)))
        return text(record.text(name))
    if isinstance(kind, T.TimestampType):
        if isinstance(record.dtype(name), T.TimestampType):
            return record.raw(name)
        return iso_timestamp(record.text(name))
    if isinstance(kind, T.BooleanType):
        return is_json_true(record.raw(name), record.dtype(name))
    return record.raw(name).try_cast(kind)


def canonical_id(record: Record, spec: DomainSpec, fallback: Column) -> Column:
    return F.coalesce(record.first_truthy(spec.id_candidates), fallback)


def to_canonical(frame: DataFrame, spec: DomainSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Schema C.  Version and times come from the event, the rest from the record."""
    record = record_of(frame)
    return frame.select(
        *keep,
        canonical_id(record, spec, F.col(spec.id_field)).alias(spec.id_field),
        *(canonical_value(record, spec, n).alias(n) for n, _ in spec.fields),
        *spec.event_fields,
    )


def kept_record(frame: DataFrame, spec: DomainSpec, sealed: bool = True) -> Column:
    """The record as JSON for quarantine; personal fields from ``_<field>_enc`` if sealed."""
    struct = frame.schema["record"].dataType
    record = record_of(frame)
    parts = [
        F.col(f"_{f.name}_enc").alias(f"{f.name}_enc")
        if sealed and f.name in spec.personal
        else record.raw(f.name).alias(f.name)
        for f in struct.fields
    ]
    return F.when(
        F.col("record").isNotNull(), F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    )
