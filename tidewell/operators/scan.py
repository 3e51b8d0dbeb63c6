"""Running values over ordered rows without one task for a group.

Rows are put in order by ranges of (group, place), so that a group of any size
lies in as many partitions as its rows need.  Every partition's share of a
group, a *run*, is folded by itself; what carries over from run to run is one
summary row each, and only those of a group are ever put side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.sources.storage import cut_lineage

RUN = "_run"


def in_runs(rows: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """The rows with their run: neighbouring ranges of a group have rising numbers.

    For plans that read the result once; write it (``cut_lineage``) where it is
    read twice, as ranges are drawn from a sample.
    """
    return rows.repartitionByRange(*by, at).withColumn(RUN, F.spark_partition_id())


def as_of(left: DataFrame, right: DataFrame, by: str, at: str) -> DataFrame:
    """``by, at, found`` for the places of ``left``: the largest ``at`` of ``right`` in the group that is not larger.

    Only the two columns are looked at and each place is answered once; ``found`` is null where nothing
    came before.
    """
    places = left.select(by, at).distinct().withColumn("_known", F.lit(None).cast(right.schema[at].dataType))
    known = right.select(by, at).distinct().withColumn("_known", F.col(at))
    # a place and what is known there fall into one row, so neither comes first
    both = places.withColumn("_asked", F.lit(True)).unionByName(known.withColumn("_asked", F.lit(False)))
    both = both.groupBy(by, at).agg(F.max("_known").alias("_known"), F.max("_asked").alias("_asked"))
    rows = cut_lineage(in_runs(both, [by], at))
    ends = rows.groupBy(by, RUN).agg(F.max("_known").alias("_last"))
    before = W.partitionBy(by).orderBy(RUN).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(by, RUN, F.max("_last").over(before).alias("_carry"))
    inside = W.partitionBy(by, RUN).orderBy(at)
    found = rows.withColumn("_here", F.max("_known").over(inside)).join(carried, [by, RUN])
    return found.where("_asked").select(by, at, F.coalesce("_here", "_carry").alias("found"))
