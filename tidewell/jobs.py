"""Jobs as commands (X2, S5): ``spark-submit -m``-style entry points over folders or a broker.

    python -m tidewell.jobs ingest --domain mail --lake L --feed F --records R [--notices N] [--letters D] [--once]
    python -m tidewell.jobs redrive --domain mail --lake L --letters D [--once]
    python -m tidewell.jobs release --domain mail --lake L --feed F --number 7
    python -m tidewell.jobs consume --domain mail --lake L --notices N --consumer search --out O [--once]
    python -m tidewell.jobs compact --domain mail --lake L --upto 1200

Checkpoints come from ``TIDEWELL_<DOMAIN>_<JOB>_CHECKPOINT``, else from ``TIDEWELL_CHECKPOINT_BASE`` or the
session's shared folder.  The field key comes from ``TIDEWELL_FIELD_KEY_B64``.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.domains.mail import MAIL
from tidewell.functions.envelope import FieldKey
from tidewell.model import DomainSpec
from tidewell.session import prepare
from tidewell.sources.feed import MAX_PER_TRIGGER, TRIGGER_SECONDS, stream_feed, stream_topic
from tidewell.sources.lake import Lake
from tidewell.sources.storage import resolve_checkpoint
from tidewell.streaming.consumers import subscribe
from tidewell.streaming.ingest import drain, feed_sink, run_ingest
from tidewell.streaming.redrive import release_due, run_redrive

DOMAINS: dict[str, DomainSpec] = {MAIL.name: MAIL}


def checkpoint_of(job: str, spec: DomainSpec, spark: SparkSession, settings: Mapping[str, str] | None = None) -> str:
    """A job's own setting, else a folder of its name below the common base."""
    found = os.environ if settings is None else settings
    base = (found.get("TIDEWELL_CHECKPOINT_BASE") or "").strip() or None
    return resolve_checkpoint([f"TIDEWELL_{spec.name}_{job}_CHECKPOINT".upper()], f"{spec.name}-{job}", base, found, spark)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewell.jobs")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *needed: str, once: bool = True) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        p.add_argument("--domain", choices=sorted(DOMAINS), default=MAIL.name)
        for option in ("lake", *needed):
            p.add_argument(f"--{option}", required=True)
        if once:
            p.add_argument("--once", action="store_true", help="read all there is and end")
        return p

    ingest = job("ingest", "feed", "records")
    ingest.add_argument("--servers", help="a broker's; --feed is then a topic")
    ingest.add_argument("--notices", help="a feed for ready notices")
    ingest.add_argument("--letters", help="a feed for dead letters")
    ingest.add_argument("--max-events", type=int, default=MAX_PER_TRIGGER)
    ingest.add_argument("--trigger-seconds", type=int, default=TRIGGER_SECONDS)
    ingest.add_argument("--once-within", help="drop messages delivered again within this time")
    job("redrive", "letters")
    job("release", "feed", "number", once=False)
    job("consume", "notices", "consumer", "out")
    job("compact", "upto", once=False)
    return top


def start(spark: SparkSession, args: argparse.Namespace, settings: Mapping[str, str] | None = None) -> StreamingQuery | None:
    """Start a job; None if it is one that ends by itself."""
    spec = DOMAINS[args.domain]
    lake = Lake(spark, args.lake, spec).ensure()
    if args.job == "compact":
        lake.compact(int(args.upto))
        return None
    if args.job == "release":
        release_due(spark, lake, spec, args.feed, int(args.number), F.current_timestamp())
        return None
    name = f"consume-{args.consumer}" if args.job == "consume" else args.job
    checkpoint = checkpoint_of(name, spec, spark, settings)
    if args.job == "redrive":
        return run_redrive(stream_feed(spark, args.letters), lake, spec, checkpoint)
    if args.job == "consume":
        return subscribe(stream_feed(spark, args.notices), lake, spec, args.consumer, args.out, checkpoint)
    if args.servers:
        feed = stream_topic(spark, args.servers, args.feed, args.max_events)
    else:
        feed = stream_feed(spark, args.feed, args.max_events)
    sinks = {kind: feed_sink(path) for kind, path in (("ready", args.notices), ("dlq", args.letters)) if path}
    return run_ingest(
        spark,
        spec,
        feed,
        lambda session: session.read.parquet(args.records),
        lake,
        FieldKey.from_env(),
        checkpoint,
        args.trigger_seconds,
        sinks=sinks,
        once_within=args.once_within,
    )


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = prepare(SparkSession.builder.appName(f"tidewell-{args.domain}-{args.job}").getOrCreate())
    query = start(spark, args)
    if query is not None:
        if args.once:
            drain(query)
        else:
            query.awaitTermination()


if __name__ == "__main__":
    main()
