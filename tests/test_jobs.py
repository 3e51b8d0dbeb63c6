"""The jobs as commands, from a feed to a consumer."""

import base64
import json

import pytest
from helpers import source
from pyspark.sql import functions as F

from tidewell import jobs
from tidewell.domains.mail import MAIL
from tidewell.sources import storage
from tidewell.sources.feed import publish, read_feed
from tidewell.sources.lake import Lake
from tidewell.streaming.consumers import received


def test_checkpoints(spark):
    settings = {"TIDEWELL_MAIL_INGEST_CHECKPOINT": " /own ", "TIDEWELL_CHECKPOINT_BASE": "/base/"}
    assert jobs.checkpoint_of("ingest", MAIL, spark, settings) == "/own"
    assert jobs.checkpoint_of("redrive", MAIL, spark, settings) == "/base/mail-redrive"
    assert jobs.checkpoint_of("redrive", MAIL, spark, {}) == f"{storage.shared_dir(spark)}/mail-redrive"


def test_commands_are_checked():
    for line in ("ingest --lake l", "release --lake l --feed f --number 1 --once", "consume --domain none --lake l"):
        with pytest.raises(SystemExit):
            jobs.parser().parse_args(line.split())


def test_jobs_from_feed_to_consumer(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEWELL_FIELD_KEY_B64", base64.b64encode(bytes(range(32))).decode())
    monkeypatch.setenv("TIDEWELL_CHECKPOINT_BASE", str(tmp_path / "cp"))
    where = {n: str(tmp_path / n) for n in ("lake", "feed", "records", "notices", "letters", "out")}
    told = {"a": {}, "b": {}, "late": {"fetch_error": "timeout"}}
    source(spark, told).write.parquet(where["records"])
    texts = [json.dumps({"mail_id": i, "version": 1}) for i in told] + ["broken"]
    rows = spark.createDataFrame([(None, bytearray(t.encode())) for t in texts], "key binary, value binary")
    publish(rows, where["feed"], 1)
    lake = Lake(spark, where["lake"], MAIL)

    def run(line):
        jobs.main(line.format(**where).split())

    ingest = "ingest --lake {lake} --feed {feed} --records {records} --notices {notices} --letters {letters} --trigger-seconds 0 --once"
    run(ingest)
    assert {r.mail_id for r in lake.state("gold").collect()} == {"a", "b"}
    assert read_feed(spark, where["letters"]).count() == 2
    run("redrive --lake {lake} --letters {letters} --once")
    source(spark, {"a": {}, "b": {}, "late": {}}).write.mode("overwrite").parquet(where["records"])
    monkeypatch.setattr(jobs.F, "current_timestamp", lambda: F.timestamp_seconds(F.lit(4_000_000_000)))
    run("release --lake {lake} --feed {feed} --number 1")
    monkeypatch.undo()
    monkeypatch.setenv("TIDEWELL_FIELD_KEY_B64", base64.b64encode(bytes(range(32))).decode())
    monkeypatch.setenv("TIDEWELL_CHECKPOINT_BASE", str(tmp_path / "cp"))
    run(ingest)
    run("compact --lake {lake} --upto 0")
    assert {r.mail_id for r in lake.state("gold").collect()} == {"a", "b", "late"} and lake.snapshot("gold")[0] == 0
    run("consume --lake {lake} --notices {notices} --consumer search --out {out} --once")
    assert {r.mail_id for r in received(spark, where["out"]).where("error IS NULL").collect()} == {"a", "b", "late"}
