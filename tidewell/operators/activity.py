"""Counts and logs about requests and consumers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import scan

SLOW_SECONDS = 0.5


def received_counts(receipts: DataFrame, consumer: str = "consumer") -> DataFrame:
    """A4."""
    return receipts.groupBy(consumer).agg(F.count("*").alias("received_count"))


def concurrency(intervals: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """A5: request total and peak of requests started and not yet finished.

    At equal times an end counts before a start, so only the net change of an
    instant matters: instants are summed before the shuffle.  The running sum
    is then taken inside runs of instants, ranges of their distribution, and the runs of a group are chained
    by their totals, so a busy group is spread out however short its busy time.
    """
    by = list(by)
    ends = F.explode(
        F.array(
            F.struct(F.col(start).alias("at"), F.lit(1).alias("d"), F.lit(1).alias("s")),
            F.struct(F.col(end).alias("at"), F.lit(-1).alias("d"), F.lit(0).alias("s")),
        )
    )
    instants = (
        intervals.select(*by, ends.alias("e"))
        .groupBy(*by, F.col("e.at").alias("at"))
        .agg(F.sum("e.d").alias("d"), F.sum("e.s").alias("s"))
    )
    inside = W.partitionBy(*by, scan.RUN).orderBy("at")
    runs = (
        scan.in_runs(instants, by, "at")
        .withColumn("run", F.sum("d").over(inside))
        .groupBy(*by, scan.RUN)
        .agg(F.max("run").alias("high"), F.sum("d").alias("d"), F.sum("s").alias("s"))
    )
    chain = W.partitionBy(*by).orderBy(scan.RUN)
    before = F.sum("d").over(chain) - F.col("d")
    return (
        runs.withColumn("level", before + F.col("high"))
        .groupBy(*by)
        .agg(F.sum("s").alias("total_requests"), F.max("level").alias("peak_active"))
    )


def receipt_summary(
    receipts: DataFrame, ident: str, consumer: str = "consumer", delay: str = "delay"
) -> DataFrame:
    """Per id and consumer how often, how slow.  Rows without a delay are ignored."""
    return (
        receipts.where(F.col(delay).isNotNull())
        .groupBy(ident, consumer)
        .agg(
            F.count("*").alias("receipts"),
            F.count_if(F.col(delay) >= SLOW_SECONDS).alias("slow_receipts"),
            F.max(delay).alias("max_delay"),
        )
    )


def receipt_rows(receipts: DataFrame, delay: str = "delay") -> DataFrame:
    """A6, row form: each receipt with its slow flag."""
    return receipts.where(F.col(delay).isNotNull()).withColumn(
        "is_slow", F.col(delay) >= SLOW_SECONDS
    )


def latest_groups(
    receipts: DataFrame, ident: str, seen: str, n: int = 10, delay: str = "delay"
) -> DataFrame:
    """L4: the ``n`` ids that appeared last, newest first, with their receipt count."""
    return (
        receipts.where(F.col(delay).isNotNull())
        .groupBy(ident)
        .agg(F.min(seen).alias("first_seen"), F.count("*").alias("receipts"))
        .orderBy(F.desc("first_seen"), F.desc(ident))
        .limit(n)
    )


def last_n(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """L2: the last ``n`` rows per group, ``position`` 1 being the newest.

    Spark applies the same limit inside each map task before the shuffle, so a
    large group arrives as at most ``n`` rows per task.
    """
    ranked = rows.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("position") <= n)


def union_logs(frames: Sequence[DataFrame]) -> DataFrame:
    """U2."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def service_health(services: DataFrame, signals: DataFrame, service: str = "service") -> DataFrame:
    """Every known service with its count; one that sent nothing is down."""
    seen = signals.groupBy(service).agg(F.count("*").alias("_n"))
    return services.join(seen, service, "left").select(
        service,
        F.when(F.col("_n").isNull(), F.lit("down")).otherwise(F.lit("running")).alias("status"),
        F.coalesce("_n", F.lit(0)).alias("received_count"),
    )
