"""Feeds with offsets, admission by events, writes that happen once."""

import json
import time

import pytest
from helpers import source
from pyspark.sql import functions as F

from tidewell.domains.mail import MAIL
from tidewell.sources import publications
from tidewell.sources.feed import as_feed, publish, read_feed, stream_feed
from tidewell.sources.lake import Lake
from tidewell.sources.publications import Feed, Position
from tidewell.streaming.consumers import received, subscribe
from tidewell.streaming.ingest import drain, feed_sink, ingest_epoch, run_ingest


def numbered(spark, first, n, files=1):
    rows = spark.range(first, first + n, numPartitions=files)
    return rows.select(F.lit(None).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))


def values(df):
    return sorted(int(bytes(r.value)) for r in df.select("value").collect())


@pytest.fixture
def feed_dir(spark, tmp_path):
    """60,000 events in four files of very different sizes."""
    where = str(tmp_path / "feed")
    assert [publish(numbered(spark, *p), where, k) for k, p in enumerate([(0, 3), (3, 41_000, 2), (41_003, 18_997)])] == [0, 1, 2]
    return where


def test_a_folder_reads_back(spark, feed_dir):
    rows = read_feed(spark, f"file:{feed_dir}")
    assert values(rows) == list(range(60_000)) and rows.select("partition", "offset").distinct().count() == 60_000
    assert rows.where("timestamp IS NULL").count() == 0


def test_publishing_again_adds_nothing(spark, feed_dir):
    before = {i.path for i in Feed(feed_dir).fs.get_file_info(publications.FileSelector(f"{feed_dir}/batch=1"))}
    publish(numbered(spark, 0, 50), feed_dir, 1)
    assert {i.path for i in Feed(feed_dir).fs.get_file_info(publications.FileSelector(f"{feed_dir}/batch=1"))} == before
    number = publish(numbered(spark, 60_000, 5), feed_dir)
    assert number > 1_000_000_000 and publish(numbered(spark, 60_005, 5), feed_dir) > number
    assert values(read_feed(spark, feed_dir)) == list(range(60_010))


def test_unfinished_publications_hold_up_later_ones(spark, tmp_path):
    where = str(tmp_path / "feed")
    publish(numbered(spark, 0, 5), where, 1)
    publish(numbered(spark, 5, 5), where, 3)
    folder = tmp_path / "feed" / "batch=2"
    folder.mkdir()
    (folder / "part-00000-left.parquet").write_bytes(b"not whole")
    assert values(read_feed(spark, where)) == [0, 1, 2, 3, 4]
    # given up after a while
    late = Feed(where, abandoned_after=0)
    assert late.admit(Position()).batch == 3
    (folder / "_SUCCESS").write_text(json.dumps({"files": []}))
    assert values(read_feed(spark, where)) == list(range(10))


def test_positions_and_pieces(feed_dir):
    feed, at, taken = Feed(feed_dir), Position(), []
    while (after := feed.admit(at, 7000)) != at:
        taken.append(sum(p.end - p.first for p in feed.pieces(at, after)))
        at = after
    assert sum(taken) == 60_000 and set(taken[:-1]) == {7000} and taken[-1] <= 7000
    assert Feed("/nowhere/at/all").admit(Position(), 10) == Position()


def collected(into):
    def batch(df, batch_id):
        into.setdefault(batch_id, []).append(values(df))

    return batch


def test_batches_hold_as_many_events_as_are_admitted(spark, feed_dir, tmp_path):
    seen = {}
    stream = stream_feed(spark, feed_dir, 5000)
    start = lambda: stream.writeStream.foreachBatch(collected(seen)).option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(start())
    sizes = [len(runs[-1]) for _, runs in sorted(seen.items())]
    assert sizes == [5000] * 12
    assert sorted(v for runs in seen.values() for v in runs[-1]) == list(range(60_000))
    publish(numbered(spark, 60_000, 7001), feed_dir, 9)
    drain(start())  # goes on where it stood
    assert [len(seen[b][0]) for b in (12, 13)] == [5000, 2001] and len(seen) == 14


def test_a_crash_repeats_one_batch_and_loses_nothing(spark, feed_dir, tmp_path):
    seen, crash = {}, {"at": 2}

    def batch(df, batch_id):
        collected(seen)(df, batch_id)
        if batch_id == crash["at"]:
            raise RuntimeError("lost")

    stream = stream_feed(spark, feed_dir, 9000)
    start = lambda: stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).start()
    with pytest.raises(Exception, match="lost"):
        drain(start())
    assert sorted(seen) == [0, 1, 2]
    crash["at"] = None
    drain(start())
    assert len(seen[2]) == 2 and seen[2][0] == seen[2][1] and all(len(runs) == 1 for b, runs in seen.items() if b != 2)
    assert sorted(v for runs in seen.values() for v in runs[-1]) == list(range(60_000))
    assert max(len(runs[-1]) for runs in seen.values()) == 9000


def test_notices_and_letters_go_to_sinks_of_their_own(spark, key, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"), MAIL, buckets=4).ensure()
    told, letters = str(tmp_path / "told"), str(tmp_path / "letters")
    sinks = {"ready": feed_sink(told), "dlq": feed_sink(letters)}
    texts = ['{"mail_id":"a","version":1}', '{"mail_id":"b","action":"delete"}', "broken"]
    rows = spark.createDataFrame([(None, bytearray(t.encode())) for t in texts], "key binary, value binary")
    for _ in range(2):  # the replay adds nothing
        ingest_epoch(MAIL, as_feed(rows, 0), source(spark, {"a": {}}), lake, key, 0, sinks)
        said = sorted(json.loads(bytes(r.value))["status"] for r in read_feed(spark, told).collect())
        assert said == ["deleted", "ready"]
        (letter,) = read_feed(spark, letters).collect()
        assert json.loads(bytes(letter.value))["validation_error"] == "invalid event payload json"
    assert lake.messages("ready").count() == lake.messages("dlq").count() == 0
    query = subscribe(stream_feed(spark, told), lake, MAIL, "search", str(tmp_path / "out"), str(tmp_path / "cp"))
    drain(query)
    assert received(spark, str(tmp_path / "out")).count() == 2


def test_ingest_from_a_feed_to_a_feed(spark, key, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"), MAIL, buckets=4).ensure()
    where, told = str(tmp_path / "feed"), str(tmp_path / "told")
    rows = spark.range(25).select(
        F.lit(None).cast("binary").alias("key"), F.format_string('{"mail_id":"m%d","version":1}', "id").cast("binary").alias("value")
    )
    publish(rows.coalesce(1), where, 1)
    records = {f"m{k}": {} for k in range(25)}
    start = lambda: run_ingest(
        spark, MAIL, stream_feed(spark, where, 10), lambda s: source(s, records), lake, key, str(tmp_path / "cp"), 0, sinks={"ready": feed_sink(told)}
    )
    drain(start())
    assert [r.events for r in lake.metrics().orderBy("epoch_id").collect()] == [10, 10, 5]
    drain(start())
    assert lake.state("gold").count() == read_feed(spark, told).count() == 25 and lake.metrics().count() == 3


def test_numbers_of_publications_grow(spark, tmp_path):
    where = str(tmp_path / "feed")
    ahead = int(time.time()) + 1000
    publish(numbered(spark, 0, 1), where, ahead)
    assert publish(numbered(spark, 1, 1), where) == ahead + 1
