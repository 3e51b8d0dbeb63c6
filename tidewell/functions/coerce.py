"""Null-safe scalar coercions shared by parsing, validation and projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python treats as white space, as a Java pattern.
SPACE = r"[\s\x1c-\x1f]"
_U = "(?U)"

# Fixed value: the same characters, listed.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the date-time texts that Python 3.13's datetime.fromisoformat accepts, as far as a pattern tells.
ISO_PATTERN = (
    r"(?s)^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|(-?)W(\d{2})(?:\6(\d))?)"
    r"(?:.(\d{2})(?:(:?)(\d{2})(?:\10(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:Z|([+-])(\d{2})(?:(:?)(\d{2})(?:\16(\d{2})(?:[.,](\d+))?)?)?)?)?\z"
)

#: The commonest of them, which a plain cast reads alike: offsets below 18 hours, fractions of at most six digits.
PLAIN_ISO = (
    r"\A(?!0000)\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)?)?\z"
)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends, in linear time."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_space(c: Column) -> Column:
    """T4: every white-space run becomes one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, rf"{_U}{SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return ~F.coalesce(c.rlike(rf"{_U}[^\s\x1c-\x1f]"), F.lit(False))


def is_empty(c: Column) -> Column:
    """True for null and '' only."""
    return F.coalesce(c == "", F.lit(True))


def iso_timestamp(c: Column) -> Column:
    """Text to timestamp, null unless Python 3.13's ``datetime.fromisoformat`` reads it.

    Extended, compact and week dates, any character before the time, hours
    alone or with minutes and seconds, fractions after a point or comma (cut
    to microseconds), ``Z`` or an offset of hours, minutes and seconds.  Texts without an offset are UTC.
    Not read, though that function reads them: a fraction without its point,
    minutes or seconds of an offset from 60 on, and a time that a hyphen joins
    to a week without its day.
    """
    return F.when(c.rlike(PLAIN_ISO), c.try_cast("timestamp")).when(c.rlike(ISO_PATTERN), _any_iso(c))


def _any_iso(c: Column) -> Column:
    """The moment of a text that ISO_PATTERN fits; its groups are read in one go."""
    listed = F.regexp_replace(c, ISO_PATTERN, "|".join(f"${n}" for n in range(1, 20)))
    return F.get(F.transform(F.array(F.split(listed, r"\|")), _moment), F.lit(0))


def _moment(groups: Column) -> Column:
    group = lambda n: F.get(groups, F.lit(n - 1))
    number = lambda n: F.when(group(n) == "", 0).otherwise(group(n)).cast("int")
    or_zero = lambda n: F.when(group(n) == "", "00").otherwise(group(n))
    month, day = (F.concat(group(n), group(n + 2)) for n in (2, 3))  # one of the two forms is empty
    fourth = F.concat(group(1), F.lit("-01-04")).try_cast("date")
    weekday = F.when(group(8) == "", 1).otherwise(number(8))
    by_week = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (number(7) - 1) * 7 + weekday - 1)
    fits = number(7).between(1, 53) & weekday.between(1, 7) & (F.weekofyear(by_week) == number(7))
    date = F.when(group(7) == "", F.concat_ws("-", group(1), month, day)).when(fits, by_week.cast("string"))
    fraction = F.rpad(F.substring(group(13), 1, 6), 6, "0")
    clock = F.concat(or_zero(9), F.lit(":"), or_zero(11), F.lit(":"), or_zero(12), F.lit("."), fraction)
    local = F.concat(date, F.lit(" "), clock, F.lit("Z")).try_cast("timestamp")
    seconds = number(15) * 3600 + number(17) * 60 + number(18)
    shift = seconds.cast("bigint") * 1_000_000 + F.rpad(F.substring(group(19), 1, 6), 6, "0").cast("bigint")
    good = (number(15) < 24) & (number(17) < 60) & (number(18) < 60) & (group(1) != "0000")
    moved = F.timestamp_micros(F.unix_micros(local) - F.when(group(14) == "-", -shift).otherwise(shift))
    return F.when(good, moved)


def text(c: Column) -> Column:
    """P10: null-safe text, null becomes ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def is_json_true(c: Column, dtype: T.DataType) -> Column:
    """True only for a boolean true; numbers and text never count."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.VariantType):
        # a variant cast would also turn 1 and "true" into true, so look at its type first
        kind = F.schema_of_variant(c)
        return F.coalesce(
            F.when(kind == "BOOLEAN", F.try_variant_get(c, "$", "boolean")), F.lit(False)
        )
    return F.lit(False)


def is_flag(c: Column, dtype: T.DataType) -> Column:
    """V10/V11 test: null, a boolean, or a number equal to 0 or 1."""
    if isinstance(dtype, T.BooleanType):
        return F.lit(True)
    if isinstance(dtype, T.VariantType):
        kind = F.schema_of_variant(c)
        number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & F.coalesce(
            F.try_variant_get(c, "$", "double").isin(0.0, 1.0), F.lit(False)
        )
        return F.coalesce(kind.isin("BOOLEAN", "VOID") | number, F.lit(True))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c.isin(0, 1), F.lit(True))
    return c.isNull()


def json_text(c: Column, dtype: T.DataType) -> Column:
    """Strings pass unchanged, anything else becomes JSON text, null stays null."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.VariantType):
        # a string variant as it is, anything else as JSON text, a JSON null as null
        return F.try_variant_get(c, "$", "string")
    return F.to_json(c, {"ignoreNullFields": "false"})


def iso_text(c: Column) -> Column:
    """Timestamp to ISO-8601 text in UTC, fraction only when there is one."""
    micros = F.date_format(c, "SSSSSS")
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )
