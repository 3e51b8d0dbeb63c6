"""The feed as a stream: one lake epoch per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.envelope import FieldKey
from tidewell.model import DomainSpec
from tidewell.operators import outcomes
from tidewell.operators.enrich import measure
from tidewell.operators.redrive import to_messages
from tidewell.plans.ingest import Outputs, judge, outputs_of, survivors
from tidewell.sources.feed import TRIGGER_SECONDS, publish
from tidewell.sources.lake import Lake


def stream_name(session: SparkSession, checkpoint: str) -> str:
    """What a query keeps over restarts: its id, which its checkpoint holds."""
    return (session.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint).replace("/", "_")


def drain(query: StreamingQuery) -> None:
    """Let a query read all that its source has, batch by batch, and stop it.

    For sources that admit by events, of which one batch is not all there is.
    """
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def ready_messages(ready: DataFrame) -> DataFrame:
    """Notices as JSON without a key."""
    return ready.select(
        F.lit(None).cast("binary").alias("key"),
        F.to_json(F.struct("*")).cast("binary").alias("value"),
    )


#: Takes the messages of one epoch; the same epoch may come again with the same messages.
Sink = Callable[[DataFrame, int], object]


def lake_sinks(lake: Lake) -> dict[str, Sink]:
    """Notices and dead letters as folders of the lake."""
    return {name: partial(_to_lake, lake, name) for name in ("ready", "dlq")}


def _to_lake(lake: Lake, name: str, messages: DataFrame, epoch: int) -> None:
    lake.write_messages(messages, name, epoch)


def feed_sink(path: str) -> Sink:
    """Messages as publications of a feed, one an epoch; an epoch that is there already is left alone."""
    return lambda messages, epoch: publish(messages, path, epoch)


def topic_sink(servers: str, topic: str, **options: str) -> Sink:
    """Messages to a broker's topic; needs the connector on the class path.  Replays repeat messages there."""

    def send(messages: DataFrame, epoch: int) -> None:
        writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
        writer.option("topic", topic).options(**options).save()

    return send


def ingest_epoch(
    spec: DomainSpec,
    feed: DataFrame,
    source: DataFrame,
    lake: Lake,
    key: FieldKey,
    epoch: int,
    sinks: Mapping[str, Sink] | None = None,
) -> Outputs | None:
    """Run one epoch to the end: tables first, then dead letters and notices.  No messages, no epoch: None.

    State is read as of the epochs before this one, so a replay sees the same
    input and writes the same rows.  ``sinks`` says where the messages
    ``ready`` and ``dlq`` go, if not to the lake's folders; sinks may run side by side.
    """
    send = lake_sinks(lake) | dict(sinks or {})
    events = survivors(feed, spec).persist(StorageLevel.MEMORY_AND_DISK)
    settled = None
    try:
        n, few = measure(events, spec.id_field)
        if not n:
            return None
        staged = lake.stage(judge(events, source, spec, key, few), "judged", epoch)
        asked = staged.where(F.col("row_id").isNotNull()).select("row_id") if few else None
        settled = outcomes.settle(staged, lake.versions(epoch, asked), spec, few=few)
        settled = settled.persist(StorageLevel.MEMORY_AND_DISK)
        out = outputs_of(settled, spec)
        changes = outcomes.changes(settled, spec)
        # small writes wait for planning and commits rather than for cores
        _side_by_side(
            staged.sparkSession,
            *(partial(lake.write_changes, changes, epoch, layer) for layer in ("silver", "gold")),
            partial(lake.write_quarantine, out.quarantine, epoch),
            partial(lake.write_metrics, out.metrics, epoch),
        )
        told = [partial(send["ready"], ready_messages(out.ready), epoch)]
        if spec.dlq_topic:
            told.append(partial(send["dlq"], to_messages(out.dead_letters), epoch))
        _side_by_side(staged.sparkSession, *told)
        return out
    finally:
        events.unpersist()
        if settled is not None:
            settled.unpersist()


def _side_by_side(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Run steps at once, each with the caller's session and job properties; a failure is raised once all have ended."""
    session = SparkSession._get_j_spark_session_class(spark._jvm)

    def run(step: Callable[[], object]) -> None:
        # a thread of the engine begins without a session of its own
        session.setActiveSession(spark._jsparkSession)
        step()

    with ThreadPoolExecutor(len(steps)) as pool:
        ran = [pool.submit(inheritable_thread_target(spark)(partial(run, step))) for step in steps]
    for r in ran:
        r.result()


def once(feed: DataFrame, within: str, by: Sequence[str] = ("partition", "offset")) -> DataFrame:
    """M2/M8: each message of a stream once, also when it is delivered again some batches later.

    ``by`` tells what makes a message the same one: its place, unless the
    feed gives it an id.  Equal contents are no sign, as the same change may be sent twice on purpose.  The
    places of the last ``within`` (by the feed's own time) are kept as state.
    """
    return feed.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(list(by))


def run_ingest(
    spark: SparkSession,
    spec: DomainSpec,
    feed: DataFrame,
    source: Callable[[SparkSession], DataFrame],
    lake: Lake,
    key: FieldKey,
    checkpoint: str,
    trigger_seconds: int = TRIGGER_SECONDS,
    available_now: bool = False,
    sinks: Mapping[str, Sink] | None = None,
    once_within: str | None = None,
) -> StreamingQuery:
    """Start the ingest of one domain.

    ``source`` is called once per batch, so that each batch sees the source as
    it is then.  With ``once_within``, say "1 hour", messages that are delivered
    again within that time are dropped (``once``).
    """
    lake.ensure()
    feed = once(feed, once_within) if once_within else feed
    base: dict[str, int] = {}

    def batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        stream = stream_name(session, checkpoint)
        if stream not in base:
            base[stream] = lake.epoch_base(stream)
        ingest_epoch(spec, df, source(session), lake, key, base[stream] + batch_id, sinks)

    writer = feed.writeStream.foreachBatch(batch).outputMode("update").queryName(f"{spec.name}-ingest")
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{trigger_seconds} seconds").start()
