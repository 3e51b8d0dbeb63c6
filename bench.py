"""Time the headline queries; prints one JSON line.

Each query is built and run to the end (rows written to Spark's no-op sink),
twice: ``queries`` holds the second run, ``first_run`` the one that also pays
for code generation and worker start.  ``BENCH_ALL=1`` times every registered
query.  The tables are first written again as one file per core, as a large
input has many splits.  ``ingest_epoch`` is one micro-batch of 5,000 events on
an empty lake, ``ingest_epoch_loaded`` one on a lake of a million rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tidewell.domains.mail import MAIL  # noqa: E402
from tidewell.plans.queries import QUERIES, QUERY_KEY, feed, source  # noqa: E402
from tidewell.session import local_session  # noqa: E402
from tidewell.sources.lake import Lake  # noqa: E402
from tidewell.streaming.ingest import ingest_epoch  # noqa: E402

TABLES = ("events", "documents", "labels", "customer", "orders", "pages", "nation")

HEADLINE = (
    "parse_events",
    "latest_per_key",
    "enrich_claim_check",
    "validate_reasons",
    "refine_pages",
    "mime_docs",
    "tagged_docs",
    "whitespace_docs",
    "protect_roundtrip",
    "stale_events",
    "gold_state",
    "upsert_merge",
    "accepted_rows",
    "redriven_events",
    "consumer_receipts",
    "last_n_per_consumer",
    "peak_concurrency",
)


def dealt_out(spark, sf_dir: str, files: int) -> str:
    out = tempfile.mkdtemp(prefix="tidewell-bench-")
    for name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.repartition(files).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return out


def time_epochs(spark, sf_dir: str) -> dict[str, float]:
    """The third of three micro-batches, on an empty lake and on a loaded one."""
    took = {}
    records = source(spark, sf_dir)
    for name, stored in (("ingest_epoch", 0), ("ingest_epoch_loaded", 1_000_000)):
        lake = Lake(spark, f"{tempfile.mkdtemp(prefix='tidewell-bench-')}/lake", MAIL).ensure()
        if stored:
            ident = F.concat(F.lit("old-"), F.col("id").cast("string")).alias("mail_id")
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in MAIL.table_schema.fields if f.name != "mail_id"]
            rows = spark.range(stored).select(ident, *blank, F.lit("U").alias("op"))
            for layer in ("silver", "gold"):
                lake.write_changes(rows, 0, layer)
        events = feed(spark, sf_dir)
        for epoch in (1, 2, 3):
            batch = events.where(F.col("offset").between(epoch * 5000, epoch * 5000 + 4999))
            start = time.perf_counter()
            ingest_epoch(MAIL, batch, records, lake, QUERY_KEY, epoch)
            took[name] = round(time.perf_counter() - start, 3)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    names = sorted(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    sf = Path(sf_dir).name.removeprefix("sf")
    sf_dir = dealt_out(spark, sf_dir, int(cpus))
    # the first job of a session pays for the JVM, not for a query
    feed(spark, sf_dir).write.format("noop").mode("overwrite").save()
    cold, took = {}, {}
    for name in names:
        for times in (cold, took):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    events = feed(spark, sf_dir).count()
    total = round(sum(took.values()), 3)
    took |= time_epochs(spark, sf_dir)
    rate = round(events / took["gold_state"]) if took.get("gold_state") else None
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": total,
                "unit": "sec",
                "queries": took,
                "first_run": cold,
                "sf": sf,
                "cpus": cpus,
                "gold_state_events_per_sec": rate,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
