"""Version checks (J2, J3) and their restatement over a whole history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.model import DomainSpec
from tidewell.operators import scan
from tidewell.sources.storage import cut_lineage


def stale_message(incoming: Column, current: Column) -> Column:
    return F.concat(
        F.lit("stale event dropped: incoming_version="),
        incoming.cast("string"),
        F.lit(", current_version="),
        current.cast("string"),
    )


def with_current_version(
    rows: DataFrame, versions: DataFrame, id_column: str, few: bool = False
) -> DataFrame:
    """Add ``current_version``, the highest stored version of the id or null.

    ``few`` says the caller has counted ``rows`` and they fit a broadcast: then
    the stored versions are filtered where they lie.
    """
    ids = rows.select(F.col(id_column).alias("_id")).distinct()
    stored = versions.toDF("_id", "_version").where(F.col("_version").isNotNull())
    stored = stored.join(F.broadcast(ids) if few else ids, "_id", "left_semi")
    top = stored.groupBy("_id").agg(F.max("_version").alias("current_version"))
    return rows.join(top, rows[id_column] == top["_id"], "left").drop("_id")


def is_stale(incoming: Column, current: Column) -> Column:
    """Strictly lower loses; equal, or no stored version, is accepted."""
    return F.coalesce(F.coalesce(incoming, F.lit(0)) < current, F.lit(False))


def fold_versions(
    history: DataFrame, spec: DomainSpec, epoch: str = "epoch_id", block: int | None = None
) -> DataFrame:
    """Replay J2/J3 over many epochs at once.

    ``history`` holds at most one row per id and epoch: that epoch's winner, be
    it a delete or an upsert that passed every check.  Adds ``delete_count``
    (deletes of the id so far) and ``current_version``, the version the row
    meets: the highest version since the last delete.  Rejected rows are lower
    than that by definition, so a running maximum over all rows is exact.

    The history of an id is cut into runs, ranges of (id, epoch) as rows are
    distributed, or of ``block`` epochs if given.  A run is folded on its own
    and leaves one summary, (deletes, best version since the last of them);
    joining two of these is associative, and only an id's summaries are put side by
    side, so an id of any length is spread over many tasks.
    """
    ident, names = spec.id_field, history.columns
    gone = F.col("action") == "DELETE"
    version = F.when(~gone, F.col("event_version"))
    if block is None:
        # written, as the rows and their summaries must agree on the ranges
        history = cut_lineage(scan.in_runs(history, [ident], epoch))
    else:
        history = history.withColumn("_run", F.floor(F.col(epoch) / F.lit(block)))

    run = W.partitionBy(ident, "_run").orderBy(epoch)
    rows = history.withColumn("_deletes", F.count(F.when(gone, True)).over(run))
    since = W.partitionBy(ident, "_run", "_deletes").orderBy(epoch)
    rows = rows.withColumn(
        "_met", F.max(version).over(since.rowsBetween(W.unboundedPreceding, -1))
    )
    # the same partitioning serves both summaries, so neither shuffles the rows again
    summary = (
        rows.groupBy(ident, "_run", "_deletes")
        .agg(F.max(version).alias("_top"))
        .groupBy(ident, "_run")
        .agg(F.max("_deletes").alias("_n"), F.max_by("_top", "_deletes").alias("_tail"))
    )
    runs = W.partitionBy(ident).orderBy("_run")
    carried = (
        summary.withColumn("_group", F.count(F.when(F.col("_n") > 0, True)).over(runs))
        .withColumn("_best", F.max("_tail").over(W.partitionBy(ident, "_group").orderBy("_run")))
        .select(
            ident,
            "_run",
            F.lag("_best").over(runs).alias("_carry"),
            (F.sum("_n").over(runs) - F.col("_n")).alias("_before"),
        )
    )
    joined = rows.join(carried, [ident, "_run"])
    met = F.when(F.col("_deletes") == 0, F.greatest("_met", "_carry")).otherwise(F.col("_met"))
    return joined.select(
        *names,
        (F.col("_before") + F.col("_deletes")).alias("delete_count"),
        met.alias("current_version"),
    )


def stale_rows(folded: DataFrame) -> DataFrame:
    """Rejected upserts of a folded history, with their message."""
    hit = (F.col("action") == "UPSERT") & is_stale(F.col("event_version"), F.col("current_version"))
    return folded.where(hit).withColumn(
        "validation_error", stale_message(F.col("event_version"), F.col("current_version"))
    )


def final_state(history: DataFrame, spec: DomainSpec, epoch: str = "epoch_id") -> DataFrame:
    """The row each id ends with, or none: the highest version since its last delete.

    Aggregates only, so one id's history never has to sit in one task: find the
    last delete per id, keep what came after it, take the maximum.
    """
    ident = spec.id_field
    ups = history.where(F.col("action") == "UPSERT")
    last = (
        history.where(F.col("action") == "DELETE")
        .groupBy(ident)
        .agg(F.max(epoch).alias("_gone"))
    )
    alive = ups.join(last, ident, "left").where(
        F.col("_gone").isNull() | (F.col(epoch) > F.col("_gone"))
    )
    rest = [c for c in history.columns if c != ident]
    best = F.max_by(F.struct(*rest), F.struct("event_version", epoch))
    return alive.groupBy(ident).agg(best.alias("_best")).select(ident, *(f"_best.{c}" for c in rest))
