"""P13, S13-S15, M3-M7, A8."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.domains.mail import MAIL
from tidewell.operators import redrive as R

SCHEMA = (
    "timestamp double, adapter_source string, entity_id string, action string, payload_json string, "
    "raw_mail_json string, validation_error string, retry_count int"
)
FETCH = "fetch failed: timeout"
OBJECT = '{"mail_id":"1","n":{"a":[1,null]},"_retry_count":7}'

CASES = [
    # id, payload, error, retries -> outcome, rebuilt payload
    ("1", OBJECT, FETCH, 0, "redriven", {"mail_id": "1", "n": {"a": [1, None]}, "_retry_count": 1}),
    ("1", OBJECT, FETCH, 2, "redriven", {"mail_id": "1", "n": {"a": [1, None]}, "_retry_count": 3}),
    ("2", '{"mail_id":"2"}', "FETCH FAILED x", 0, "redriven", {"mail_id": "2", "_retry_count": 1}),
    ("3", "{}", "supply response error: not found", 3, "exhausted", None),
    ("4", None, "fetch failed", 0, "redriven", {"mail_id": "4", "action": "UPSERT", "_retry_count": 1}),
    ("5", "broken {", "fetch failed", 1, "redriven", {"mail_id": "5", "action": "UPSERT", "_retry_count": 2}),
    ("6", "[1]", "fetch failed", None, "redriven", {"mail_id": "6", "action": "UPSERT", "_retry_count": 1}),
    ("7", "{}", "title is required", 0, "permanent", None),
    ("8", None, "stale event dropped: incoming_version=1, current_version=2", 0, "permanent", None),
    (None, "x", None, 0, "permanent", None),
    (None, "{}", "supply response error: busy", 0, "redriven", {"_retry_count": 1}),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(100.25, "s", c[0], "UPSERT", c[1], None, c[2], c[3]) for c in CASES]
    letters = spark.createDataFrame(rows, SCHEMA)
    return R.classify(R.from_messages(R.to_messages(letters)), MAIL)


def test_s13_wire_form(spark):
    rows = [(1.5, "s", "a", "UPSERT", '{"x":1}', None, "e", 2), (1.5, "s", None, "UPSERT", "raw", '{"t":null}', None, 0)]
    one, two = R.to_messages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (bytes(one.key), two.key) == (b"a", None)
    body = json.loads(bytes(one.value))
    assert body["payload_json"] == {"x": 1} and body["raw_mail_json"] is None and body["retry_count"] == 2
    body = json.loads(bytes(two.value))
    assert body["payload_json"] == "raw" and body["raw_mail_json"] == {"t": None} and body["entity_id"] is None


def test_m3_m4_outcomes(judged):
    got = sorted((r.entity_id or "", r.retry_count or 0, r.outcome) for r in judged.collect())
    assert got == sorted((c[0] or "", c[3] or 0, c[4]) for c in CASES)


def test_m5_payloads(spark, judged):
    sent = R.redriven(judged, MAIL).collect()
    got = sorted(json.dumps(json.loads(bytes(r.value)), sort_keys=True) for r in sent)
    assert got == sorted(json.dumps(c[5], sort_keys=True) for c in CASES if c[5])
    assert sorted(bytes(r.key) for r in sent if r.key) == [b"1", b"1", b"2", b"4", b"5", b"6"]


def test_m6_backoff(judged):
    before, after = F.timestamp_millis(F.lit(105_249)), F.timestamp_millis(F.lit(105_250))
    assert R.redriven(judged, MAIL, before).count() == 0
    assert R.redriven(judged, MAIL, after).count() == 7


def test_m7_a8(judged):
    assert {r.outcome for r in R.parked(judged).collect()} == {"exhausted", "permanent"}
    counts = {(r.outcome, r.retry_count): r.letters for r in R.outcome_counts(judged).collect()}
    assert counts[("permanent", 0)] == 3 and counts[("exhausted", 3)] == 1
