"""Reading a JSON message body with variant getters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.coerce import SPACE, iso_timestamp

# Action words that mean a removal.
DELETE_WORDS = ("delete", "deleted", "remove", "removed")


#: Where the message sits inside the parsed envelope.
ROOT = "$[0]"

_DELETE_PATTERN = rf"(?iU)^{SPACE}*(?:{'|'.join(DELETE_WORDS)}){SPACE}*$"


def envelope(raw: Column) -> Column:
    """Parse ``[<raw>,<hash of raw>]`` once.

    The JSON reader stops at the end of the first value, so trailing text
    would go unnoticed.  With the hash as a second element, any text that
    closes the array early or adds an element moves or removes the hash.
    """
    return F.try_parse_json(
        F.concat(F.lit("["), raw, F.lit(","), F.xxhash64(raw).cast("string"), F.lit("]"))
    )


def is_one_object(raw: Column, parsed: Column) -> Column:
    """``raw`` is exactly one JSON object."""
    intact = F.try_variant_get(parsed, "$[1]", "bigint") == F.xxhash64(raw)
    return F.coalesce(intact & raw.rlike(r"^[ \t\r\n]*\{"), F.lit(False))


def field_text(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"{ROOT}.{name}", "string")


def action(parsed: Column) -> Column:
    """DELETE for the removal words, UPSERT for anything else."""
    gone = field_text(parsed, "action").rlike(_DELETE_PATTERN)
    return F.when(gone, F.lit("DELETE")).otherwise(F.lit("UPSERT"))


def version(parsed: Column) -> Column:
    """P5: integer version, 0 when absent or not a number."""
    return F.coalesce(
        F.try_variant_get(parsed, f"{ROOT}.version", "bigint"), F.lit(0).cast("bigint")
    )


def moment(parsed: Column, name: str) -> Column:
    """P6."""
    return iso_timestamp(field_text(parsed, name))


def retry_count(payload_text: Column) -> Column:
    """``_retry_count`` of the payload text, 0 when it is missing or unreadable."""
    return F.coalesce(
        F.try_variant_get(F.try_parse_json(payload_text), "$._retry_count", "int"), F.lit(0)
    )
