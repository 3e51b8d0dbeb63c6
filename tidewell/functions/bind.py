"""Evaluate an expression once, whatever reads it afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Add a column that later filters and projections read instead of copying its expression.

    The optimizer moves filters below a projection by pasting the projected
    expressions into them, so a parse used by five columns and two filters
    would run many times.  It does not look through a generator; a one-element
    array costs next to nothing.
    """
    return df.select("*", F.explode(F.array(c)).alias(name))
