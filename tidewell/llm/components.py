"""Connected components by alternating star contractions, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.storage import cut_lineage


def _seen(edges: DataFrame) -> tuple:
    """A digest of the edge set; a round that leaves it alone is the last."""
    mark = F.xxhash64("high", "low")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mark), F.sum(F.pmod(mark, F.lit(1_000_003)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.select("high", "low").union(edges.select("low", "high")).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    tied = both.where(F.col("other") > F.col("node")).join(least, "node")
    return tied.select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    smaller = edges.join(least, "high").where(F.col("low") != F.col("least"))
    tied = smaller.select(F.col("low").alias("high"), F.col("least").alias("low"))
    return tied.union(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge to another one.

    ``edges`` has two columns of one ordered type; direction, repeats, loops
    and null ends do not matter.  ``component`` is the smallest node
    reachable.  A node of any degree costs one row per edge: minima are
    aggregated before they are shuffled, and joins on a hot node can be split.
    The number of rounds grows with the logarithm of the longest chain.
    """
    a, b = edges.columns
    # a null end leaves both equal, so such a row goes with the loops
    pairs = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
    now = cut_lineage(pairs.where(F.col("high") > F.col("low")).distinct())
    before = _seen(now)
    while before[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        after = _seen(now)
        if after == before:
            break
        before = after
    return now.select(F.col("high").alias("node"), F.col("low").alias("component"))
