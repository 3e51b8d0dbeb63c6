"""What the physical plans must look like for the work to spread."""

import json

import pytest
from helpers import feed, source, versions
from pyspark.sql import functions as F

from tidewell.domains.mail import MAIL
from tidewell.operators import enrich
from tidewell.operators.latest import latest_per_key
from tidewell.operators.parse import parse_feed, usable
from tidewell.plans import ingest
from tidewell.plans import queries as Q
from tidewell.plans.ingest import judge, survivors
from tidewell.sources import storage

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_combines_before_the_shuffle(spark):
    text = plan(latest_per_key(usable(parse_feed(feed(spark, ["{}"]), MAIL)), MAIL))
    before, after = text.split("Exchange hashpartitioning", 1)
    assert "max_by" in before and "partial_max_by" in after


def test_feed_is_parsed_once_per_message(spark, tmp_path):
    feed(spark, ["{}"]).write.parquet(str(tmp_path / "f"))
    events = survivors(spark.read.parquet(str(tmp_path / "f")), MAIL)
    assert plan(events).count("parseJson") == 1
    rows = usable(parse_feed(spark.read.parquet(str(tmp_path / "f")), MAIL))
    assert plan(rows).count("parseJson") == 1


def test_few_ids_travel_to_the_source(spark, key, tmp_path):
    source(spark, {"a": {}}).write.parquet(str(tmp_path / "s"))
    survivors(feed(spark, [json.dumps({"mail_id": "a"})]), MAIL).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    text = plan(judge(events, spark.read.parquet(str(tmp_path / "s")), MAIL, key, True))
    assert "BroadcastHashJoin [lookup_id" in text and "LeftSemi, BuildRight" in text
    assert "EvalPython" not in text


@pytest.mark.parametrize("limit", [0, enrich.BROADCAST_BYTES])
def test_a_batch_broadcasts_ids_only_within_the_limit(spark, key, monkeypatch, limit):
    asked = []
    real = ingest.judge
    monkeypatch.setattr(enrich, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(ingest, "judge", lambda *a, **k: asked.append(a[4]) or real(*a, **k))
    messages = feed(spark, [json.dumps({"mail_id": str(i)}) for i in range(20)])
    out = ingest.process(MAIL, messages, source(spark, {"1": {}}), versions(spark, {}), key)
    assert asked == [limit > 0]
    # both forms find the same
    assert [r.mail_id for r in out.accepted.collect()] == ["1"]


def test_folds_move_no_payload(spark):
    for rows in (Q.latest_event(spark, DATA), Q._winners(spark, DATA)):
        assert not any("payload_json" in line for line in plan(rows).splitlines() if "Aggregate" in line or "Exchange" in line)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_query_multiplies_rows_out_or_runs_python_per_row(spark, name):
    text = plan(Q.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "EvalPython" not in text and "InArrow" not in text and "collect_list" not in text


def test_scans_read_only_what_is_asked(spark):
    text = plan(Q.list_records(spark, DATA))
    assert "n_chars" not in text and "quality" not in text
    assert "value" not in plan(Q.latest_event(spark, DATA)).split("ReadSchema")[1].split("\n")[0].replace("value_text", "")


def test_peak_uses_small_chains(spark):
    text = plan(Q.peak_concurrency(spark, DATA))
    assert "partial_sum" in text  # instants are summed before they move


def test_no_machine_local_tables_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="shared folder"):
        storage.shared_dir(Session())


def test_cut_lineage_tables_can_be_dropped(spark):
    df = storage.cut_lineage(spark.range(3))
    assert df.count() == 3
    where = storage._own_tables(spark)
    assert storage.children(spark, where)
    storage.drop_tables(spark)
    assert not storage.exists(spark, where)


def test_messages_of_one_row_group_are_parsed_by_many_tasks(spark):
    events = Q.feed(spark, DATA).where("timestamp >= '2024-01-12'")
    text = events._jdf.queryExecution().optimizedPlan().toString()
    above, below = text.split("RepartitionByExpression", 1)
    assert "StructsToJson" in above and "Filter" not in above and "Filter" in below
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which puts so few rows together again
    try:
        sizes = [r["count"] for r in events.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_latest_sorts_by_the_id_first(spark):
    text = plan(survivors(feed(spark, ["{}"]), MAIL))
    assert "Sort [mail_id" in text and "Sort [_alone" not in text


@pytest.mark.parametrize("name", ["tagged_docs", "mime_docs", "deep_mime_docs", "refine_docs", "refine_pages"])
def test_texts_of_one_row_group_are_cleaned_by_many_tasks(spark, name):
    rows = Q.QUERIES[name](spark, DATA)
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1]
    assert "regexp_replace" not in below and "base64" not in below and "concat" not in below
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which puts so few rows together again
    try:
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4
