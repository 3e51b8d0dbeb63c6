"""Building blocks for validation rules.

A rule is a Column that holds the message when the record breaks it and null
when it does not; ``first_failure`` takes the first message in order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.coerce import is_blank, is_empty, is_flag, iso_timestamp, strip

# Fixed value: accepted e-mail addresses.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"


class Record:
    """Typed access to the fields of a record struct; absent fields read as null."""

    def __init__(self, struct: T.StructType, column: str = "record"):
        self._types = {f.name: f.dataType for f in struct.fields}
        self._column = column

    def raw(self, name: str) -> Column:
        if name not in self._types:
            return F.lit(None).cast("string")
        return F.col(f"{self._column}.{name}")

    def dtype(self, name: str) -> T.DataType:
        return self._types.get(name, T.StringType())

    def text(self, name: str) -> Column:
        kind = self.dtype(name)
        if isinstance(kind, T.VariantType):
            return F.try_variant_get(self.raw(name), "$", "string")
        return self.raw(name).cast("string")

    def first_truthy(self, names: Iterable[str]) -> Column:
        """The first value that is neither null, '', 0 nor false, as text."""
        picks = []
        for n in names:
            c = self.text(n)
            falsy = is_empty(c)
            if not isinstance(self.dtype(n), T.StringType):
                falsy = falsy | c.isin("0", "0.0", "false")
            picks.append(F.when(~falsy, c))
        return F.coalesce(*picks)


def required(c: Column, message: str) -> Column:
    return F.when(is_blank(c), F.lit(message))


def email(c: Column, message: str) -> Column:
    good = F.coalesce(strip(c).rlike(EMAIL_PATTERN), F.lit(False))
    return F.when(~good, F.concat(F.lit(message), F.coalesce(c, F.lit(""))))


def optional_email(c: Column, message: str) -> Column:
    """Only null and '' are skipped; blanks and lists fail."""
    return F.when(~is_empty(c), email(c, message))


def optional_moment(c: Column, message: str) -> Column:
    return F.when(~is_empty(c) & iso_timestamp(c).isNull(), F.concat(F.lit(message), c))


def flag(c: Column, dtype: T.DataType, message: str) -> Column:
    return F.when(~is_flag(c, dtype), F.lit(message))


def first_failure(messages: Iterable[Column]) -> Column:
    return F.coalesce(*messages)
