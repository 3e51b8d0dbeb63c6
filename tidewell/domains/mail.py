"""The mail domain."""

from __future__ import annotations

from pyspark.sql import Column

from tidewell.functions import rules as R
from tidewell.model import DomainSpec

_ID_CANDIDATES = ("id", "mail_id")


def mail_rules(record: R.Record) -> list[Column]:
    """V1-V11 in order of precedence, on the record before cleaning."""
    text = record.text
    return [
        R.required(record.first_truthy(_ID_CANDIDATES), "mail_id is required"),
        R.required(text("title"), "title is required"),
        R.required(text("body"), "body is required"),
        R.required(text("sender"), "sender is required"),
        R.email(text("sender"), "invalid sender email: "),
        R.required(text("receiver"), "receiver is required"),
        R.email(text("receiver"), "invalid receiver email: "),
        R.optional_email(text("cc"), "invalid cc email: "),
        R.optional_moment(text("sent_at"), "invalid sent_at datetime: "),
        R.flag(record.raw("read_yn"), record.dtype("read_yn"), "read_yn must be boolean"),
        R.flag(
            record.raw("has_attachment"),
            record.dtype("has_attachment"),
            "has_attachment must be boolean",
        ),
    ]


MAIL = DomainSpec(
    name="mail",
    id_field="mail_id",
    feed_topic="mail.events",
    ready_topic="mail.ready",
    dlq_topic="mail.events.dlq",
    source_label="mail-supply-default",
    fields=(
        ("title", "string"),
        ("body", "string"),
        ("sender", "string"),
        ("sender_name", "string"),
        ("receiver", "string"),
        ("receiver_name", "string"),
        ("cc", "string"),
        ("sent_at", "timestamp"),
        ("read_yn", "boolean"),
        ("has_attachment", "boolean"),
    ),
    id_candidates=_ID_CANDIDATES,
    rules=mail_rules,
    cleaned=(("body", "always"), ("title", "if_tagged")),
    personal=("sender", "sender_name", "receiver", "receiver_name", "cc"),
)
