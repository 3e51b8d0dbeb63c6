"""A4-A7, L2, L4, U2, J6, J7, S16-S21, P15."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from helpers import source
from pyspark.sql import functions as F

from tidewell.domains.mail import MAIL
from tidewell.operators import activity, fanout, merge, scan, serving
from tidewell.sources.feed import as_feed, list_records

T0 = datetime(2025, 1, 1)


def sweep(rows):
    points = sorted([(s, 1) for s, _ in rows] + [(e, -1) for _, e in rows])
    level = peak = 0
    for _, d in points:
        level += d
        peak = max(peak, level)
    return peak


@pytest.fixture(params=[1, 4, 40])
def partitions(spark, request):
    """So many ranges, however few the rows."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (str(request.param), "false"), strict=True):
        spark.conf.set(n, v)
    yield request.param
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_a5_peak(spark, partitions):
    rng = random.Random(2)
    rows = []
    for who in ("a", "b"):
        for _ in range(300):
            start = T0 + timedelta(seconds=rng.randrange(4000))
            rows.append((who, start, start + timedelta(seconds=rng.choice([0, 1, 30, 900]))))
    rows.append(("single", T0, T0))
    df = spark.createDataFrame(rows, "who string, s timestamp, e timestamp")
    got = {r.who: r for r in activity.concurrency(df, ["who"], "s", "e").collect()}
    for who in ("a", "b", "single"):
        mine = [(s, e) for w, s, e in rows if w == who]
        assert (got[who].total_requests, got[who].peak_active) == (len(mine), max(0, sweep(mine)))


def test_a5_a_busy_hour_is_spread(spark, partitions):
    """All requests of one service within a quarter of an hour."""
    rng = random.Random(4)
    rows = []
    for _ in range(4000):
        start = T0 + timedelta(milliseconds=rng.randrange(900_000))
        rows.append(("hot", start, start + timedelta(milliseconds=rng.randrange(1, 60_000))))
    df = spark.createDataFrame(rows, "who string, s timestamp, e timestamp")
    (got,) = activity.concurrency(df, ["who"], "s", "e").collect()
    assert (got.total_requests, got.peak_active) == (4000, sweep([r[1:] for r in rows]))
    sizes = [r["count"] for r in scan.in_runs(df, ["who"], "s").groupBy(scan.RUN).count().collect()]
    assert len(sizes) == partitions and max(sizes) <= 2 * 4000 / partitions


def test_j6_late_readers_get_the_row_of_the_notice(spark):
    log = [("a", 1, "U", "first"), ("a", 3, "D", None), ("a", 3, "U", "second"), ("a", 7, "D", None), ("b", 2, "U", "other")]
    told = [("a", 1, "ready"), ("a", 2, "ready"), ("a", 3, "ready"), ("a", 5, "ready"), ("a", 7, "deleted"), ("b", 1, "ready"), ("c", 9, "ready"), (None, 4, "ready"), ("a", 5, "ready")]
    changes = spark.createDataFrame([(i, e, op, t, 0) for i, e, op, t in log], "mail_id string, epoch_id bigint, op string, title string, span bigint")
    ready = spark.createDataFrame(told, "mail_id string, epoch_id bigint, status string")
    rows = serving.notices_as_of(ready, changes, MAIL)
    assert rows.columns == ["mail_id", "epoch_id", "status", "title", "error"]
    got = sorted(((r.mail_id, r.epoch_id, r.title, r.error) for r in rows.collect()), key=repr)
    miss = "mail_id not found: "
    assert got == sorted(
        [("a", 1, "first", None), ("a", 2, "first", None), ("a", 3, "second", None), ("a", 5, "second", None), ("a", 5, "second", None),
         ("a", 7, None, miss + "a"), ("b", 1, None, miss + "b"), ("c", 9, None, miss + "c"), (None, 4, None, miss)], key=repr
    )


def test_a6_l4_receipts(spark):
    rows = [("m1", "search", 0.5, 1), ("m1", "search", 0.1, 2), ("m1", "mobile", 0.49, 3), ("m2", "graph", None, 4), ("m3", "graph", 2.0, 5)]
    df = spark.createDataFrame(rows, "mail_id string, consumer string, delay double, seen int")
    got = {(r.mail_id, r.consumer): (r.receipts, r.slow_receipts, r.max_delay) for r in activity.receipt_summary(df, "mail_id").collect()}
    assert got == {("m1", "search"): (2, 1, 0.5), ("m1", "mobile"): (1, 0, 0.49), ("m3", "graph"): (1, 1, 2.0)}
    top = activity.latest_groups(df, "mail_id", "seen", n=10).collect()
    assert [(r.mail_id, r.receipts) for r in top] == [("m3", 1), ("m1", 3)]
    assert [r.mail_id for r in activity.latest_groups(df, "mail_id", "seen", n=1).collect()] == ["m3"]


def test_l2_last_n(spark):
    df = spark.createDataFrame([(c, i) for c in "ab" for i in range(30)] + [("c", 1)], "c string, i int")
    got = activity.last_n(df, ["c"], [F.desc("i")], 20).collect()
    assert sorted((r.c, r.i) for r in got) == [("a", i) for i in range(10, 30)] + [("b", i) for i in range(10, 30)] + [("c", 1)]
    plan = activity.last_n(df, ["c"], [F.desc("i")], 20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the limit also runs before the shuffle


def test_a4_a7_u2(spark):
    services = spark.createDataFrame([("search",), ("mobile",)], "service string")
    logs = activity.union_logs([spark.createDataFrame([("search",)] * 3, "service string"), spark.createDataFrame([("other",)], "service string")])
    got = {r.service: (r.status, r.received_count) for r in activity.service_health(services, logs).collect()}
    assert got == {"search": ("running", 3), "mobile": ("down", 0)}
    assert {r.service: r.received_count for r in activity.received_counts(logs, "service").collect()} == {"search": 3, "other": 1}


def test_j7_entitlement(spark):
    requests = spark.createDataFrame([("k1", "mails", 1), ("k1", "stats", 2), ("k2", "stats", 3), (None, "mails", 4), ("bad", "mails", 5)], "api_key string, route string, n int")
    creds = spark.createDataFrame([("k1", "mobile"), ("k2", "graph")], "api_key string, consumer string")
    members = spark.createDataFrame([("mobile", "g-mails"), ("mobile", "g-users"), ("graph", "g-mails"), ("graph", "g-admin")], "consumer string, member_group string")
    routes = spark.createDataFrame([("mails", "g-mails"), ("mails", "g-users"), ("stats", "g-admin")], "route string, member_group string")
    assert sorted(r.n for r in serving.entitled(requests, creds, members, routes).collect()) == [1, 3]
    assert sorted(r.n for r in serving.refused(requests, creds, members, routes).collect()) == [2, 4, 5]


def gold(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in MAIL.table_schema.names) for r in rows], MAIL.table_schema)


def test_p15_s20_l3_serving(spark):
    df = gold(spark, [
        {"mail_id": "1"},
        {"mail_id": "2", "title": "t", "read_yn": True, "event_version": 4, "occurred_at": datetime(2025, 1, 2, 3, 4, 5), "ingested_at": T0},
        {"mail_id": "2", "title": "newer", "event_version": 9, "occurred_at": datetime(2025, 1, 2, 3, 4, 5, 60)},
    ])
    (one,) = serving.serve_lookup(df, MAIL, "1").collect()
    assert one.mail.asDict() == {
        "id": "1", "title": "", "body": "", "sender_enc": "", "sender_name_enc": "", "receiver_enc": "", "receiver_name_enc": "",
        "cc_enc": "", "sent_at": None, "read_yn": False, "has_attachment": False, "event_version": 0,
        "source_updated_at": None, "occurred_at": None,
    }
    assert (one.mail_id, one.source) == ("1", "local.gold.mail")
    (two,) = serving.serve_lookup(df, MAIL, "2").collect()
    assert (two.mail.title, two.mail.occurred_at) == ("newer", "2025-01-02T03:04:05.000060+00:00")
    assert serving.serve_lookup(df, MAIL, "9").count() == 0
    assert serving.serve_lookup(df, MAIL, "x' OR '1'='1").count() == 0  # H14
    whole = {r.mail.occurred_at for r in serving.serve_view(df, MAIL).collect()}
    assert "2025-01-02T03:04:05+00:00" in whole


def test_s20_filter_reaches_the_files(spark, tmp_path):
    where = str(tmp_path / "gold")
    gold(spark, [{"mail_id": str(i)} for i in range(5)]).write.parquet(where)
    plan = serving.serve_lookup(spark.read.parquet(where), MAIL, "3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(mail_id,3)" in plan and "ingested_at" not in plan.split("ReadSchema")[1]


def test_j6_misses_stay(spark):
    ready = spark.createDataFrame([("1", "ready"), ("2", "deleted")], "mail_id string, status string")
    rows = gold(spark, [{"mail_id": "1", "title": "t"}])
    got = serving.notices_with_rows(ready, rows, MAIL).collect()
    assert {r.mail_id: (r.title, r.error) for r in got} == {"1": ("t", None), "2": (None, "mail_id not found: 2")}


def test_s16_s17_s19_messages(spark):
    changes = spark.createDataFrame([("m1", "created"), (None, "created")], "mail_id string, action string")
    sent = as_feed(fanout.event_messages(changes, MAIL), 5)
    bodies = [json.loads(bytes(r.value)) for r in sent.collect()]
    assert bodies[0] == {"mail_id": "m1", "action": "created"} and re.fullmatch("[0-9a-f]{8}", bodies[1]["mail_id"])
    assert len({(r.partition, r.offset) for r in sent.collect()}) == 2
    topics = ["search-events", "mobile-events", "graph-events"]
    fanned = fanout.fan_out(sent.where(F.col("value").cast("string").contains("m1")), topics)
    assert sorted(r.topic for r in fanned.collect()) == sorted(topics)
    assert fanned.select("value").distinct().count() == 1
    assert fanout.subscription(fanned, topics[1]).count() == 1


def test_s18_skips_what_is_no_object(spark):
    rows = [(bytearray(b'{"mail_id":"1","status":"ready"}'),), (bytearray(b"[1]"),), (bytearray(b"x"),), (None,)]
    got = fanout.notices_from_messages(spark.createDataFrame(rows, "value binary"), MAIL).collect()
    assert [tuple(r) for r in got] == [("1", "ready")]


def test_s21_listing(spark):
    assert sorted(r.lookup_id for r in list_records(source(spark, {"a": {}, "b": {}})).collect()) == ["a", "b"]


def test_j4_j5(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("d", 2)], "id string, v int")
    assert sorted(map(tuple, merge.replace_by_ids(stored, new, "id").collect())) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    assert sorted(map(tuple, merge.delete_by_ids(stored, new, "id").collect())) == [("a", 1), ("c", 1)]
