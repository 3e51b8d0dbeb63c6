"""Lake tables without row-level SQL.

Each layer is an append-only change log with one folder per epoch, plus
snapshots that ``compact`` writes now and then::

    <root>/<layer>/log/span=<epoch // SPAN>/epoch_id=<epoch>/
    <root>/<layer>/snapshots/upto=<epoch>-buckets=<n>/bucket=<b>/

The current state is the newest snapshot, less the ids of the log after it,
plus the last log row of each of those ids that is an upsert.  Only spans
after the snapshot are listed.  Writing an epoch again replaces it.

One writer per lake.  A snapshot counts once Spark has put ``_SUCCESS`` in it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.model import FEED_SCHEMA, DomainSpec
from tidewell.sources import storage
from tidewell.sources.feed import as_feed

SPAN = 4096
BUCKETS = 64
#: Rows of a row group of a snapshot, at most.
ROW_GROUP = 100_000
LAYERS = ("silver", "gold")
_LONG = T.LongType()


class Lake:
    def __init__(self, spark: SparkSession, root: str, spec: DomainSpec, buckets: int = BUCKETS):
        self.spark, self.root, self.spec, self.buckets = spark, root.rstrip("/"), spec, buckets

    # -- layout -----------------------------------------------------------

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def ensure(self) -> Lake:
        """Make the folders; calling it again changes nothing."""
        for layer in LAYERS:
            storage.make_dirs(self.spark, self.path(layer, "log"))
        for name in ("quarantine", "dlq", "ready", "metrics", "staging"):
            storage.make_dirs(self.spark, self.path(name))
        return self

    @property
    def log_schema(self) -> T.StructType:
        extra = [T.StructField("op", T.StringType())]
        keys = [T.StructField("span", _LONG), T.StructField("epoch_id", _LONG)]
        return T.StructType(self.spec.table_schema.fields + extra + keys)

    # -- reading ----------------------------------------------------------

    def snapshot(self, layer: str, before: int | None = None) -> tuple[int, int, str] | None:
        """(last epoch inside, bucket count, path) of the newest usable snapshot."""
        home = self.path(layer, "snapshots")
        found = []
        for name in storage.children(self.spark, home):
            m = re.fullmatch(r"upto=(\d+)-buckets=(\d+)", name)
            if m and (before is None or int(m[1]) < before):
                if storage.exists(self.spark, f"{home}/{name}/_SUCCESS"):
                    found.append((int(m[1]), int(m[2]), f"{home}/{name}"))
        return max(found, default=None)

    def log(self, layer: str, after: int = -1, before: int | None = None) -> DataFrame:
        """Log rows of the epochs after ``after`` and before ``before``."""
        home = self.path(layer, "log")
        spans = [
            f"{home}/{name}"
            for name in storage.children(self.spark, home)
            if name.startswith("span=") and int(name[5:]) >= (after + 1) // SPAN
        ]
        if not spans:
            return self.spark.createDataFrame([], self.log_schema)
        rows = self.spark.read.schema(self.log_schema).option("basePath", home).parquet(*spans)
        rows = rows.where(F.col("epoch_id") > after)
        return rows if before is None else rows.where(F.col("epoch_id") < before)

    def _rows(
        self, layer: str, columns: list[str], before: int | None, entity_id: str | None, ids: DataFrame | None = None
    ) -> DataFrame:
        """Last row per id; with ``ids`` (one small column) both log and snapshot are cut to those first."""
        ident = self.spec.id_field
        rest = [c for c in columns if c != ident] + ["op"]
        snap = self.snapshot(layer, before)
        tail = self.log(layer, snap[0] if snap else -1, before)
        if entity_id is not None:
            tail = tail.where(F.col(ident) == F.lit(entity_id))
        if ids is not None:
            asked = F.broadcast(ids.toDF(ident).distinct())
            tail = tail.join(asked, ident, "left_semi")
        # inside one epoch deletes run before upserts, so the upsert is the later one
        when = F.struct("epoch_id", F.col("op") == "U")
        last = tail.groupBy(ident).agg(F.max_by(F.struct(*rest), when).alias("_r"))
        last = last.select(ident, *(f"_r.{c}" for c in rest))
        if snap is None:
            return last
        _, buckets, where = snap
        base = self.spark.read.parquet(where)
        if entity_id is not None:
            bucket = F.pmod(F.xxhash64(F.lit(entity_id)), F.lit(buckets))
            base = base.where((F.col("bucket") == bucket) & (F.col(ident) == F.lit(entity_id)))
        if ids is not None:
            # at most as many numbers as there are buckets; other buckets are not read
            own = F.pmod(F.xxhash64(ident), F.lit(buckets))
            asked_buckets = [r[0] for r in ids.toDF(ident).select(own).distinct().collect()]
            base = base.where(F.col("bucket").isin(asked_buckets)).join(asked, ident, "left_semi")
        kept = base.select(ident, *rest).join(last.select(ident), ident, "left_anti")
        return kept.unionByName(last)

    def state(
        self,
        layer: str,
        columns: list[str] | None = None,
        before: int | None = None,
        entity_id: str | None = None,
        ids: DataFrame | None = None,
    ) -> DataFrame:
        """The live rows of a layer, as of the epochs before ``before`` if given, of all or some ids."""
        names = self.spec.table_schema.names if columns is None else columns
        return self._rows(layer, names, before, entity_id, ids).where(F.col("op") == "U").select(*names)

    def versions(self, before: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """J2's input: id and stored version, two columns of silver.

        Under ``versioned`` deletes the tombstones answer too (D10).
        """
        names = [self.spec.id_field, "event_version"]
        rows = self._rows("silver", names, before, None, ids)
        if self.spec.delete_policy != "versioned":
            rows = rows.where(F.col("op") == "U")
        return rows.select(*names)

    def lookup(self, entity_id: str) -> DataFrame:
        """The gold row of one id; one bucket of the snapshot is read."""
        return self.state("gold", entity_id=entity_id)

    def quarantine(self) -> DataFrame:
        schema = T.StructType(
            self.spec.quarantine_schema.fields + [T.StructField("epoch_id", _LONG)]
        )
        return self.spark.read.schema(schema).parquet(self.path("quarantine"))

    def messages(self, name: str) -> DataFrame:
        """The messages written to ``dlq`` or ``ready``."""
        schema = T.StructType(FEED_SCHEMA.fields + [T.StructField("epoch_id", _LONG)])
        return self.spark.read.schema(schema).parquet(self.path(name))

    def metrics(self) -> DataFrame:
        names = ("events", "accepted", "deleted", "quarantined", "epoch_id")
        schema = T.StructType([T.StructField(n, _LONG) for n in names])
        return self.spark.read.schema(schema).parquet(self.path("metrics"))

    # -- writing ----------------------------------------------------------

    def _put(self, df: DataFrame, where: str, epoch: int, spans: bool = False) -> None:
        keys = ["span", "epoch_id"] if spans else ["epoch_id"]
        if spans:
            df = df.withColumn("span", F.lit(epoch // SPAN).cast("bigint"))
        df = df.withColumn("epoch_id", F.lit(epoch).cast("bigint"))
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*keys).parquet(where)

    def write_changes(self, changes: DataFrame, epoch: int, layer: str) -> None:
        """Upserts and deletes of one epoch in one write."""
        names = [*self.spec.table_schema.names, "op"]
        self._put(changes.select(*names), self.path(layer, "log"), epoch, spans=True)

    def write_quarantine(self, rows: DataFrame, epoch: int) -> None:
        """S11."""
        self._put(rows, self.path("quarantine"), epoch)

    def write_messages(self, messages: DataFrame, name: str, epoch: int) -> None:
        """S12/S13 into a folder that can be streamed again."""
        self._put(as_feed(messages, epoch), self.path(name), epoch)

    def write_metrics(self, row: DataFrame, epoch: int) -> None:
        self._put(row, self.path("metrics"), epoch)

    def stage(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        """Write a frame once per epoch and read it back; a replay reads what is there.

        Fixes drawn nonces and lookup answers for every output of the epoch,
        also when executors are lost or the batch is run again.
        """
        where = self.path("staging", name, f"epoch={epoch}")
        if not storage.exists(self.spark, f"{where}/_SUCCESS"):
            df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def epoch_base(self, stream_id: str, written: tuple[str, ...] = (), prefix: str = "epoch=") -> int:
        """First epoch of a stream that writes below the folders ``written`` (the lake's judged epochs by default).

        Batch numbers restart at 0 with a new checkpoint; the base keeps a new
        stream from overwriting the epochs of an older one.
        """
        home = self.path("streams", stream_id)
        known = [int(n[5:]) for n in storage.children(self.spark, home) if n.startswith("base=")]
        if known:
            return min(known)
        newest = -1
        for where in written or (self.path("staging", "judged"),):
            for n in storage.children(self.spark, where):
                if n.startswith(prefix):
                    newest = max(newest, int(n[len(prefix) :]))
        storage.make_dirs(self.spark, f"{home}/base={newest + 1}")
        return newest + 1

    def compact(self, upto: int) -> None:
        """Fold the log up to an epoch into a snapshot, bucketed and sorted by id."""
        ident = self.spec.id_field
        for layer in LAYERS:
            done = self.snapshot(layer)
            if done and done[0] >= upto:
                continue
            rows = self._rows(layer, self.spec.table_schema.names, upto + 1, None)
            if self.spec.delete_policy != "versioned":
                rows = rows.where(F.col("op") == "U")
            where = self.path(layer, "snapshots", f"upto={upto}-buckets={self.buckets}")
            # sorted by id and with filters of the ids, so that a look-up reads one row group at most
            (
                rows.withColumn("bucket", F.pmod(F.xxhash64(ident), F.lit(self.buckets)))
                .repartitionByRange("bucket", ident)
                .sortWithinPartitions("bucket", ident)
                .write.mode("overwrite")
                .option(f"parquet.bloom.filter.enabled#{ident}", "true")
                .option(f"parquet.bloom.filter.expected.ndv#{ident}", ROW_GROUP)
                .option("parquet.block.row.count.limit", ROW_GROUP)
                .partitionBy("bucket")
                .parquet(where)
            )

    # -- SQL names --------------------------------------------------------

    def create_tables(self) -> None:
        """Databases and external tables over the same folders, if absent."""
        name = self.spec.name
        stored = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.log_schema.fields)
        held = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in self.spec.quarantine_schema.fields
        )
        for layer in LAYERS:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {layer}.{name}_log ({stored}) USING parquet "
                f"PARTITIONED BY (span, epoch_id) LOCATION '{self.path(layer, 'log')}'"
            )
        self.spark.sql("CREATE DATABASE IF NOT EXISTS quarantine")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS quarantine.{name} ({held}, epoch_id BIGINT) USING parquet "
            f"PARTITIONED BY (epoch_id) LOCATION '{self.path('quarantine')}'"
        )

    def refresh_tables(self) -> None:
        """Make epochs written since the last call visible to SQL."""
        name = self.spec.name
        for table in (f"silver.{name}_log", f"gold.{name}_log", f"quarantine.{name}"):
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def check_table_round_trip(spark: SparkSession, table: str) -> DataFrame:
    """Create, drop, create again, insert, select."""
    rows = spark.createDataFrame([(1, "first"), (2, "second")], "id BIGINT, data STRING")
    ddl = f"CREATE TABLE IF NOT EXISTS {table} (id BIGINT, data STRING) USING parquet"
    spark.sql(ddl)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(ddl)
    rows.write.insertInto(table)
    return spark.table(table).orderBy("id")
