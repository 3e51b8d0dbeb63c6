"""Schemas and the domain description every operator is driven by.

A *domain* (mail today; approvals, calendars or boards tomorrow) is a
``DomainSpec``: names, field types, validation rules as Column expressions,
and the lists of fields to clean and to encrypt.  No operator in this package
mentions a concrete domain (X1-X3).

Frame contracts
---------------
feed      ``key BINARY, value BINARY, partition INT, offset BIGINT, timestamp TIMESTAMP``
source    ``lookup_id STRING, record STRUCT<...>, fetch_error STRING, response_error STRING``
          (the two error columns are optional)
versions  ``<id_field> STRING, event_version BIGINT``
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

FEED_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

#: What a dead-letter message carries once its JSON is read back (struct Q).
DEAD_LETTER_FIELDS = (
    "timestamp DOUBLE, adapter_source STRING, entity_id STRING, action STRING, "
    "payload_json VARIANT, raw_mail_json VARIANT, validation_error STRING, retry_count INT"
)

_TYPES = {
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "bigint": T.LongType(),
}


@dataclass(frozen=True)
class DomainSpec:
    """Everything that differs between two domains."""

    name: str
    id_field: str
    feed_topic: str
    ready_topic: str
    dlq_topic: str | None
    source_label: str
    #: canonical record fields and their types, in table order
    fields: tuple[tuple[str, str], ...]
    #: record fields tried in turn for the canonical id
    id_candidates: tuple[str, ...]
    #: record -> messages in precedence order; a message is null when the rule holds
    rules: Callable[[object], list[Column]]
    #: (field, policy) with policy ``always`` or ``if_tagged``
    cleaned: tuple[tuple[str, str], ...] = ()
    personal: tuple[str, ...] = ()
    #: ``unconditional`` drops a row whatever its version; ``versioned`` keeps tombstones
    delete_policy: str = "unconditional"
    max_retries: int = 3
    retry_delay_seconds: int = 5
    event_fields: tuple[str, ...] = field(
        default=("event_version", "source_updated_at", "occurred_at")
    )

    def field_type(self, name: str) -> T.DataType:
        return _TYPES[dict(self.fields)[name]]

    @property
    def canonical_schema(self) -> T.StructType:
        """Schema C: clear text row."""
        out = [T.StructField(self.id_field, T.StringType())]
        out += [T.StructField(n, _TYPES[t]) for n, t in self.fields]
        return T.StructType(out + _event_columns())

    @property
    def table_schema(self) -> T.StructType:
        """Schema S: silver and gold row, personal fields as ``*_enc``."""
        out = [T.StructField(self.id_field, T.StringType())]
        out += [
            T.StructField(f"{n}_enc", T.StringType())
            if n in self.personal
            else T.StructField(n, _TYPES[t])
            for n, t in self.fields
        ]
        return T.StructType(
            out + _event_columns() + [T.StructField("ingested_at", T.TimestampType())]
        )

    @property
    def quarantine_schema(self) -> T.StructType:
        """Schema X."""
        names = (self.id_field, "action", "payload_json", "raw_mail_json", "validation_error")
        return T.StructType(
            [T.StructField(n, T.StringType()) for n in names]
            + [T.StructField("quarantined_at", T.TimestampType())]
        )

    def describe(self) -> str:
        return (
            f"{self.feed_topic} -> lookup -> validate/clean/encrypt -> "
            f"silver,gold/quarantine -> {self.ready_topic}"
        )


def _event_columns() -> list[T.StructField]:
    return [
        T.StructField("event_version", T.LongType()),
        T.StructField("source_updated_at", T.TimestampType()),
        T.StructField("occurred_at", T.TimestampType()),
    ]
