"""P1-P7, A1, A2, W1, W2."""

import random
from datetime import datetime, timezone

import pytest
from helpers import feed
from pyspark.sql import functions as F

from tidewell.domains.mail import MAIL
from tidewell.functions.coerce import iso_timestamp
from tidewell.operators.latest import latest_per_key
from tidewell.operators.parse import BAD_JSON, delete_ids, parse_feed, unusable, usable

MISSING = "event mail_id is missing"


def parsed(spark, values):
    rows = parse_feed(feed(spark, values), MAIL).orderBy("offset").collect()
    return [r.asDict() for r in rows]


@pytest.mark.parametrize(
    "value",
    [
        "invalid-raw-string-not-json", "[1]", "5", '"x"', None, "", '{"mail_id":"1"} trailing',
        '{"mail_id":"1"},{"mail_id":"2"}', '{"mail_id":"1"}] [', '{"mail_id":"1"},5',
        '{"mail_id":"1","mail_id":"2"}', "{'mail_id': 1}", '{"mail_id":"1"', "null", "true",
        '{"mail_id":"1"}/*c*/', '{"mail_id":"1"}}', '{"mail_id":"1",}',
    ],
)
def test_p2_broken_json(spark, value):
    (row,) = parsed(spark, [value])
    assert (row["parse_error"], row["mail_id"], row["payload_json"]) == (BAD_JSON, None, value)


@pytest.mark.parametrize("value", ['{"mail_id":"  "}', '{"mail_id":null}', '{"title":"t"}', '{"mail_id":"\\u00a0"}'])
def test_p3_missing_id(spark, value):
    (row,) = parsed(spark, [value])
    assert (row["parse_error"], row["mail_id"], row["payload_json"]) == (MISSING, None, value)


def test_p1_p3_ids(spark):
    rows = parsed(spark, ['{"mail_id":7}', '{"mail_id":" 8 "}', '  {"mail_id":"9"}\n'])
    assert [r["mail_id"] for r in rows] == ["7", " 8 ", "9"]
    assert all(r["parse_error"] is None for r in rows)


def test_p4_action(spark):
    words = ['"created"', '" Removed "', "null", '"DELETE"', '"deleted"', '"remove"', '"drop"', "1", '"\\u00a0delete"']
    rows = parsed(spark, [f'{{"mail_id":"1","action":{w}}}' for w in words] + ['{"mail_id":"1"}'])
    want = ["UPSERT", "DELETE", "UPSERT", "DELETE", "DELETE", "DELETE", "UPSERT", "UPSERT", "DELETE", "UPSERT"]
    assert [r["action"] for r in rows] == want


def test_p5_version(spark):
    given = ["3.7", '"3.7"', "true", "null", '" 4 "', "1e3", "3", '"4"', '"1_000"', "-2", "[1]", "{}"]
    rows = parsed(spark, [f'{{"mail_id":"1","version":{g}}}' for g in given] + ['{"mail_id":"1"}'])
    assert [r["event_version"] for r in rows] == [3, 0, 1, 0, 4, 1000, 3, 4, 0, -2, 0, 0, 0]


def test_p6_moments(spark):
    given = {
        "2025-05-21T09:00:00": datetime(2025, 5, 21, 9),
        "2025-05-21T09:00:00Z": datetime(2025, 5, 21, 9),
        "2025-05-21T09:00:00+09:00": datetime(2025, 5, 21, 0),
        "2025-05-21T09:00:00.123456": datetime(2025, 5, 21, 9, 0, 0, 123456),
        "2025-05-21": datetime(2025, 5, 21),
        "2025-05-21 09:30": datetime(2025, 5, 21, 9, 30),
        "2025": None, "10:00": None, "": None, "x": None, "2025-02-30": None,
        "2025-05-21T09": datetime(2025, 5, 21, 9), "20250521T090000": datetime(2025, 5, 21, 9), "2025-W21-3": datetime(2025, 5, 21),
        "2025-05-21x09:00,5": None, "2025-05-21x09:00:00,5": datetime(2025, 5, 21, 9, 0, 0, 500000), "2025-05-21\n": None,
        "2025-05-21T09:00:00+0900": datetime(2025, 5, 21, 0), "2025-05-21T09:00+09:00:30": datetime(2025, 5, 20, 23, 59, 30),
        "2025-05-21T09:00:00.1234567": datetime(2025, 5, 21, 9, 0, 0, 123456), "2021-W53-1": None,
        "2025-05-21T24:00:00": None, "now": None, "epoch": None,
    }
    rows = parsed(spark, [f'{{"mail_id":"1","occurred_at":"{g}"}}' for g in given])
    assert [r["occurred_at"] for r in rows] == list(given.values())


def test_a1_w2_latest(spark):
    values = [
        '{"mail_id":"a","version":1}', '{"mail_id":"a","version":3}', '{"mail_id":"a","version":2}',
        '{"mail_id":"b","version":1,"occurred_at":"2025-01-02"}',
        '{"mail_id":"b","version":1,"occurred_at":"2025-01-01"}',
        '{"mail_id":"c","action":"x"}', '{"mail_id":"c","action":"delete"}',
        '{"mail_id":"d","source_updated_at":"2025-01-01"}', '{"mail_id":"d"}',
    ]
    best = latest_per_key(usable(parse_feed(feed(spark, values), MAIL)), MAIL)
    assert {r.mail_id: r.offset for r in best.collect()} == {"a": 1, "b": 3, "c": 6, "d": 7}


def test_a1_matches_sequential_loop(spark):
    rng = random.Random(7)
    values, want = [], {}
    for i in range(400):
        ident, ver, day = f"m{rng.randrange(25)}", rng.randrange(4), rng.choice([None, 1, 2, 3])
        extra = "" if day is None else f',"occurred_at":"2025-01-0{day}"'
        values.append(f'{{"mail_id":"{ident}","version":{ver}{extra}}}')
        rank = (ver, day or 0, i)
        if ident not in want or rank >= want[ident]:
            want[ident] = rank
    best = latest_per_key(usable(parse_feed(feed(spark, values), MAIL)), MAIL)
    assert {r.mail_id: r.offset for r in best.collect()} == {k: v[2] for k, v in want.items()}


def test_p7_a2_l1_delete_ids(spark):
    values = ['{"mail_id":"b","action":"delete"}', '{"mail_id":"a","action":"removed"}',
              '{"mail_id":"b","action":"remove"}', '{"mail_id":"c"}']
    events = usable(parse_feed(feed(spark, values), MAIL))
    assert [r.mail_id for r in delete_ids(events, MAIL).collect()] == ["a", "b"]


def test_every_message_lands_on_one_side(spark):
    values = ["x", '{"mail_id":"1"}', "{}", None, '{"mail_id":"1","action":"delete"}']
    rows = parse_feed(feed(spark, values), MAIL)
    assert (usable(rows).count(), unusable(rows).count()) == (2, 3)


def test_p6_every_combination_of_forms(spark):
    """Against the standard library of Python 3.13."""
    days = "2025-05-21 20250521 2025-W21-3 2025W213 2025-W21 2020-W53-7 2021-W53-1 2025-02-29 2024-02-29 2025-W00-1 2025-W21-8".split()
    times = ["", "T09", "x09:00", " 09:00:30", "T0900", "T090030", "T09:00:30.5", "T09:00:30,1234567", "T09:00:30.123456", "T24:00", "T09:60", "T09:0030", "T9"]
    zones = ["", "Z", "+09:00", "-0930", "+09", "+09:00:30", "+17:59", "-18:30", "+24:00", "+0900:30", "z", "+09:00:30.5", " ", "\n"]
    # a hyphen after a week without its day is read as the day's, here
    texts = [d + t + z for d in days for t in times for z in zones if d + t + z != "2025-W21-0930"]

    def read(text):
        try:
            at = datetime.fromisoformat(text)
        except ValueError:
            return None
        return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(iso_timestamp(F.col("t"))).collect()]
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != read(t)] == []
