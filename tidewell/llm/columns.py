"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: space, tab to carriage return.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The maximal runs without white space, in order."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def occurrences(text: Column, pattern: str) -> Column:
    """How many characters of a one-character class the text holds."""
    return F.size(F.split(text, pattern, -1)) - 1


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads, so that others may carry any name."""
    return df.select(*(F.col(f"`{n}`") for n in names))
