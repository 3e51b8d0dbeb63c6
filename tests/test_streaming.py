"""The pipeline end to end on folders."""

import json
import re

import pytest
from helpers import source
from pyspark.sql import functions as F

from tidewell.domains.mail import MAIL
from tidewell.functions import rules as R
from tidewell.model import DomainSpec
from tidewell.sources import storage
from tidewell.sources.feed import as_feed, publish, read_feed, stream_feed, stream_folder
from tidewell.sources.lake import Lake, check_table_round_trip
from tidewell.streaming.consumers import received, subscribe
from tidewell.streaming.ingest import drain, ingest_epoch, run_ingest
from tidewell.streaming.redrive import due_letters, judged_letters, release_due, run_redrive


def event(ident, version=0, action="x", **more):
    return json.dumps({"mail_id": ident, "action": action, "version": version, **more})


def messages(spark, values):
    return spark.createDataFrame([(None, bytearray(v.encode())) for v in values], "key binary, value binary").coalesce(1)


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def state(lake, layer="gold"):
    return {r.mail_id: (r.event_version, r.title) for r in lake.state(layer).collect()}


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"), MAIL, buckets=4).ensure()


def step(spark, lake, key, epoch, values, records):
    return ingest_epoch(MAIL, as_feed(messages(spark, values), epoch), source(spark, records), lake, key, epoch)


def test_s8_s10_m2_epochs_and_compaction(spark, lake, key):
    recs = {"a": {}, "b": {}, "c": {"title": ""}}
    step(spark, lake, key, 0, [event("a", 5), event("b", 1), event("c", 1)], recs)
    assert state(lake) == {"a": (5, "Hello"), "b": (1, "Hello")}
    step(spark, lake, key, 1, [event("a", 4), event("b", 9, "delete"), event("zz", 0, "delete")], recs)
    assert state(lake) == state(lake, "silver") == {"a": (5, "Hello")}
    lake.compact(1)
    assert state(lake) == {"a": (5, "Hello")} and lake.snapshot("gold")[0] == 1
    # a delete forgets the version, so an older upsert is accepted again
    step(spark, lake, key, 2, [event("b", 0), event("a", 5)], {"a": {"title": "again"}, "b": {}})
    want = {"a": (5, "again"), "b": (0, "Hello")}
    assert state(lake) == want
    assert {r.mail_id for r in lake.state("gold", before=2).collect()} == {"a"}
    lake.compact(2)
    assert state(lake) == want
    assert {r.mail_id: r.event_version for r in lake.versions().collect()} == {"a": 5, "b": 0}
    # One bucket of the snapshot, filter in the scan
    one = lake.lookup("a")
    assert [r.title for r in one.collect()] == ["again"] and lake.lookup("zz").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(mail_id,a)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    errors = {r.validation_error for r in lake.quarantine().collect()}
    assert errors == {"title is required", "stale event dropped: incoming_version=4, current_version=5"}


def snapshot_of(lake):
    tables = {}
    for layer in ("silver", "gold"):
        rows = lake.log(layer).drop("span").collect()
        tables[layer] = sorted(map(str, rows))
    tables["quarantine"] = sorted(str(r) for r in lake.quarantine().drop("quarantined_at").collect())
    for name in ("dlq", "ready"):
        tables[name] = lake.messages(name).count()
    tables["metrics"] = sorted(map(str, lake.metrics().collect()))
    return tables


def test_m8_replay_changes_nothing(spark, lake, key):
    recs = {"a": {}, "b": {"sender": "bad"}}
    values = [event("a", 2), event("b", 1), "broken", event("d", 1, "delete")]
    step(spark, lake, key, 0, values, recs)
    first = snapshot_of(lake)
    # again, as after a crash, with a source that has changed meanwhile
    step(spark, lake, key, 0, values, {"a": {"title": "other"}})
    assert snapshot_of(lake) == first


def test_m8_crash_between_writes(spark, lake, key, monkeypatch):
    values = [event("a", 2), "broken"]
    real = Lake.write_quarantine

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Lake, "write_quarantine", fail)
    with pytest.raises(RuntimeError):
        step(spark, lake, key, 0, values, {"a": {}})
    monkeypatch.setattr(Lake, "write_quarantine", real)
    step(spark, lake, key, 0, values, {"a": {}})
    silver, gold = lake.log("silver").collect(), lake.log("gold").collect()
    assert len(silver) == 1 and silver[0].sender_enc == gold[0].sender_enc
    assert lake.quarantine().count() == 1


def test_stream_end_to_end_with_redrive_and_consumer(spark, lake, key, tmp_path):
    feed_dir, cp = str(tmp_path / "feed"), str(tmp_path / "cp")
    storage.make_dirs(spark, feed_dir)
    records = {"a": {}, "late": {"fetch_error": "timeout"}}

    def supply(session):
        return source(session, records)

    def ingest():
        return run_ingest(spark, MAIL, stream_folder(spark, feed_dir, 1), supply, lake, key, f"{cp}/ingest", available_now=True)

    publish(messages(spark, [event("a", 1), event("late", 1), "invalid-raw-string-not-json"]), feed_dir, 1)
    publish(messages(spark, [event("a", 2), '{"title":"no id"}']), feed_dir, 2)
    run(ingest())
    assert state(lake) == {"a": (2, "Hello")}
    assert lake.metrics().agg(F.sum("events"), F.sum("accepted"), F.sum("quarantined")).collect()[0][:] == (3, 2, 3)
    assert lake.metrics().count() == 2  # one epoch per admitted file
    letters = [json.loads(bytes(r.value)) for r in lake.messages("dlq").collect()]
    assert sorted(x["validation_error"] for x in letters) == [
        "event mail_id is missing", "fetch failed: timeout", "invalid event payload json"
    ]

    # re-drive: not before its time, once, and with the count carried along
    run(run_redrive(stream_folder(spark, lake.path("dlq")), lake, MAIL, f"{cp}/redrive", available_now=True))
    assert judged_letters(spark, lake, "parked").count() == 2
    early, later = F.lit("2020-01-01").cast("timestamp"), F.lit("2100-01-01").cast("timestamp")
    release_due(spark, lake, MAIL, feed_dir, 1, early)
    release_due(spark, lake, MAIL, feed_dir, 2, later)
    release_due(spark, lake, MAIL, feed_dir, 3, later)
    records["late"] = {}
    run(ingest())
    assert state(lake) == {"a": (2, "Hello"), "late": (1, "Hello")}
    assert lake.metrics().agg(F.sum("events")).collect()[0][0] == 4
    payload = [r.payload_json for r in lake.path and spark.read.parquet(lake.path("staging", "judged", "*")).where("entity_id='late'").collect()]
    assert sorted("_retry_count" in p for p in payload) == [False, True]

    # consumers: one checkpoint each, each sees every notice
    out = str(tmp_path / "received")
    for who in ("search", "mobile"):
        run(subscribe(stream_folder(spark, lake.path("ready")), lake, MAIL, who, out, f"{cp}/{who}", available_now=True))
    got = received(spark, out).groupBy("consumer").count().collect()
    assert {r.consumer: r["count"] for r in got} == {"search": 3, "mobile": 3}
    assert received(spark, out).where("error is not null").count() == 0


def test_new_checkpoint_does_not_overwrite_epochs(spark, lake, key, tmp_path):
    for i, ident in enumerate(["a", "b"]):
        feed_dir = str(tmp_path / f"feed{i}")
        storage.make_dirs(spark, feed_dir)
        publish(messages(spark, [event(ident, 1)]), feed_dir, 1)
        run(run_ingest(spark, MAIL, stream_folder(spark, feed_dir), lambda s: source(s, {"a": {}, "b": {}}), lake, key, str(tmp_path / f"cp{i}"), available_now=True))
    assert set(state(lake)) == {"a", "b"}


def approval_rules(record):
    return [
        R.required(record.first_truthy(("id",)), "approval_id is required"),
        R.required(record.text("subject"), "subject is required"),
        R.email(record.text("drafter"), "invalid drafter: "),
    ]


APPROVAL = DomainSpec(
    name="approval", id_field="approval_id", feed_topic="approval.events", ready_topic="approval.ready", dlq_topic=None,
    source_label="approval-supply", fields=(("subject", "string"), ("drafter", "string"), ("amount", "bigint"), ("due_at", "timestamp")),
    id_candidates=("id",), rules=approval_rules, cleaned=(("subject", "always"),), personal=("drafter",),
)


def test_x1_x3_second_domain(spark, tmp_path, key):
    lake = Lake(spark, str(tmp_path / "approvals"), APPROVAL).ensure()
    rows = [("1", ("1", "<b>Buy</b>", "a@x.example", "12", "2025-01-01")), ("2", ("2", "x", "nobody", "1", None))]
    src = spark.createDataFrame(rows, "lookup_id string, record struct<id:string,subject:string,drafter:string,amount:string,due_at:string>")
    values = ['{"approval_id":"1","version":3}', '{"approval_id":"2"}', '{"mail_id":"3"}']
    out = ingest_epoch(APPROVAL, as_feed(messages(spark, values), 0), src, lake, key, 0)
    (r,) = lake.state("gold").collect()
    assert (r.approval_id, r.subject, r.amount, r.event_version, r.due_at.year) == ("1", "Buy", 12, 3, 2025)
    assert "drafter" not in r.asDict()
    assert {x.validation_error for x in lake.quarantine().collect()} == {"invalid drafter: nobody", "event approval_id is missing"}
    assert lake.messages("dlq").count() == 0  # no dead-letter topic, no letters
    assert json.loads(bytes(lake.messages("ready").collect()[0].value)) == {"approval_id": "1", "status": "ready"}
    assert "approval.events" in APPROVAL.describe() and out.settled is not None


def test_s6_s22_catalog(spark, lake, key):
    step(spark, lake, key, 0, [event("a", 1), "broken"], {"a": {}})
    lake.create_tables()
    lake.create_tables()
    lake.refresh_tables()
    assert spark.sql("SELECT mail_id, op, epoch_id FROM gold.mail_log").collect()[0][:] == ("a", "U", 0)
    assert spark.sql("SELECT count(*) FROM quarantine.mail").collect()[0][0] == 1
    rows = check_table_round_trip(spark, "silver.sanity").collect()
    assert [tuple(r) for r in rows] == [(1, "first"), (2, "second")]
    for t in ("silver.sanity", "silver.mail_log", "gold.mail_log", "quarantine.mail"):
        spark.sql(f"DROP TABLE {t}")


def test_s5_checkpoint_choice(spark, tmp_path):
    pick = storage.resolve_checkpoint
    assert pick(["A", "B"], "cp", "/base", {"A": " ", "B": " /given "}) == "/given"
    assert pick(["A"], "cp", "/base/", {}) == "/base/cp"
    assert pick(["A"], "cp", None, {}, spark) == f"{storage.shared_dir(spark)}/cp"


def test_s14_s15_feed_order(spark, tmp_path):
    where = str(tmp_path / "f")
    publish(messages(spark, ["1", "2"]), where, 1)
    publish(messages(spark, ["3"]), where, 2)
    rows = spark.read.parquet(where).orderBy("partition", "offset").collect()
    assert [bytes(r.value) for r in rows] == [b"1", b"2", b"3"]


def test_s15_s16_the_later_publication_of_a_key_sorts_later(spark, tmp_path):
    where = str(tmp_path / "f")
    for batch, tasks in ((1, 4), (2, 1), (3, 3)):
        rows = [(bytearray(k.encode()), bytearray(f"{k}{batch}".encode())) for k in "abcdefgh"]
        publish(spark.createDataFrame(rows, "key binary, value binary").repartition(tasks), where, batch)
    got = {}
    for r in spark.read.parquet(where).orderBy("partition", "offset").collect():
        got.setdefault(bytes(r.key).decode(), []).append(bytes(r.value).decode()[1:])
    assert got == {k: ["1", "2", "3"] for k in "abcdefgh"}
    assert spark.read.parquet(where).select("partition", "offset").distinct().count() == 24


def test_m8_a_new_redrive_checkpoint_replaces_nothing(spark, lake, key, tmp_path):
    step(spark, lake, key, 0, [event("a", 1), event("b", 1)], {})
    feed = stream_folder(spark, lake.path("dlq"), 1)
    for n in ("one", "two"):
        run(run_redrive(feed, lake, MAIL, str(tmp_path / n), available_now=True))
    waiting = judged_letters(spark, lake, "waiting")
    assert waiting.count() == 4 and waiting.select("epoch_id").distinct().count() >= 2
    sent = str(tmp_path / "sent")
    release_due(spark, lake, MAIL, sent, 0, F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    assert spark.read.parquet(sent).count() == 2  # each letter once


def test_m2_m8_a_message_delivered_again_two_batches_later_enters_one_epoch(spark, lake, key, tmp_path):
    where = str(tmp_path / "feed")
    first = as_feed(messages(spark, [event("a", 1), event("b", 1)]), 1)
    first.coalesce(1).write.parquet(f"{where}/1")
    rows = [as_feed(messages(spark, [event("c", 1)]), 2), spark.read.parquet(f"{where}/1").where("value LIKE '%\"a\"%'"), as_feed(messages(spark, [event("a", 1)]), 4)]
    for k, df in enumerate(rows):
        df.coalesce(1).write.parquet(f"{where}/{k + 2}")
    start = lambda feed, cp, to, **more: run(run_ingest(spark, MAIL, feed, lambda s: source(s, {c: {} for c in "abc"}), to, key, str(tmp_path / cp), available_now=True, **more))
    start(stream_folder(spark, where, 1), "cp", lake, once_within="1 hour")
    # the fourth file holds a new message that says the same, which is no repeat
    assert [r.events for r in lake.metrics().where("events > 0").orderBy("epoch_id").collect()] == [2, 1, 1]
    assert lake.metrics().agg(F.sum("events")).first()[0] == 4


def letter(ident, moment, error="fetch failed: timeout"):
    body = {"timestamp": moment, "adapter_source": "s", "entity_id": ident, "action": "UPSERT", "payload_json": {"mail_id": ident},
            "raw_mail_json": None, "validation_error": error, "retry_count": 0}
    return json.dumps(body)


def test_m6_a_release_reads_the_buckets_that_came_due(spark, lake, tmp_path):
    feed, sent = str(tmp_path / "dlq"), str(tmp_path / "sent")
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds))
    judge = lambda: drain(run_redrive(stream_feed(spark, feed), lake, MAIL, str(tmp_path / "cp")))
    out = lambda: sorted(json.loads(bytes(r.value))["mail_id"] for r in read_feed(spark, sent).collect())
    publish(messages(spark, [letter(f"a{k}", 600 * k) for k in range(5)] + [letter("no", 0, "title is required")]), feed, 1)
    judge()
    release_due(spark, lake, MAIL, sent, 1, at(610))
    assert out() == ["a0", "a1"]  # due five seconds after 0 and 600
    # a letter of a later epoch that was due long ago is found, one seen before is not sent again
    publish(messages(spark, [letter("b", 30), letter("c", 1830)]), feed, 2)
    judge()
    since = (610 // 60, 0)
    plan = due_letters(spark, lake, at(1260), since)._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "due#" in pruned and "<= 21" in pruned and ">= 10" in pruned and "epoch_id#" in pruned and "> 0" in pruned
    for _ in range(2):  # run again, as after a crash
        release_due(spark, lake, MAIL, sent, 2, at(1260))
        assert out() == ["a0", "a1", "a2", "b"]
    release_due(spark, lake, MAIL, sent, 3, at(1260))
    release_due(spark, lake, MAIL, sent, 4, at(99_999))
    assert out() == ["a0", "a1", "a2", "a3", "a4", "b", "c"]
    assert len(storage.children(spark, sent)) == 3  # a release of nothing publishes nothing


def scanned(df):
    """Rows and files that the scans of a plan read, from their metrics."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), {"rows": 0, "files": 0}
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if "Scan" in node.nodeName():
            for name, key in (("rows", "numOutputRows"), ("files", "numFiles")):
                metric = node.metrics().get(key)
                found[name] += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_s20_j2_look_ups_skip_buckets_and_row_groups(spark, tmp_path, monkeypatch):
    """A million ids in a snapshot: what is read for one, for a missing one, and for a hundred."""
    monkeypatch.setattr("tidewell.sources.lake.ROW_GROUP", 1000)
    lake = Lake(spark, str(tmp_path / "big"), MAIL, buckets=64).ensure()
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in MAIL.table_schema.fields if f.name not in ("mail_id", "event_version")]
    ident = F.concat(F.lit("m"), F.col("id").cast("string")).alias("mail_id")
    rows = spark.range(1_000_000).select(ident, F.lit(1).cast("bigint").alias("event_version"), *blank, F.lit("U").alias("op"))
    lake.write_changes(rows, 0, "silver")
    lake.write_changes(rows.where("mail_id < 'm2'"), 0, "gold")
    lake.compact(0)
    made = [f for f in (tmp_path / "big" / "silver" / "snapshots").rglob("*.parquet")]
    assert sum(f.stat().st_size for f in made) < 30_000_000  # filters are as large as their row groups need
    one = lake.state("silver", columns=["mail_id", "event_version"], entity_id="m77777")
    assert one.count() == 1 and scanned(one)["rows"] <= 2000  # a row group of a thousand, not one of sixteen thousand
    assert scanned(lake.state("silver", columns=["mail_id", "event_version"], entity_id="m77777x"))["rows"] <= 1000
    few = spark.createDataFrame([(f"m{k}",) for k in (5, 50, 500)], "mail_id string")
    some = lake.versions(ids=few)
    assert some.count() == 3 and scanned(some)["rows"] < 3 * 20_000
    hundred = spark.createDataFrame([(f"m{k * 9973}",) for k in range(100)], "mail_id string")
    assert lake.versions(ids=hundred).count() == 100


def test_state_of_some_ids_reads_only_those(spark, lake, key):
    step(spark, lake, key, 0, [event(c, 1) for c in "abcd"], {c: {} for c in "abcd"})
    lake.compact(0)
    step(spark, lake, key, 1, [event("a", 2), event("e", 1), event("b", 2, "delete")], {"a": {}, "e": {}})
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "mail_id string")
    rows = lake.state("gold", ids=ids)
    assert {r.mail_id: r.event_version for r in rows.collect()} == {"a": 2, "c": 1}
    assert {tuple(r) for r in lake.versions(ids=ids).collect()} == {("a", 2), ("c", 1)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    aggregate = plan.index("Aggregate")
    assert "LeftSemi" in plan[aggregate:]  # below it: cut before rows are folded
