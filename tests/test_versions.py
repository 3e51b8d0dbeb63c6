"""W3 against a sequential fold, and the flagship plan on the same histories."""

import json
import random

import pytest
from helpers import feed, source

from tidewell.domains.mail import MAIL
from tidewell.operators import scan
from tidewell.operators.versions import final_state, fold_versions, stale_rows
from tidewell.plans import history as H


def histories(seed, ids=40, epochs=60, deletes=0.15):
    rng = random.Random(seed)
    rows = []
    for i in range(ids):
        for e in range(epochs):
            if rng.random() < 0.6:
                gone = rng.random() < deletes
                rows.append((f"m{i}", e, "DELETE" if gone else "UPSERT", rng.randrange(8)))
    return rows


def replay(rows):
    stored, stale, final = {}, set(), {}
    for ident, epoch, action, version in sorted(rows, key=lambda r: r[1]):
        if action == "DELETE":
            stored.pop(ident, None)
            final.pop(ident, None)
        elif ident in stored and version < stored[ident]:
            stale.add((ident, epoch, version, stored[ident]))
        else:
            stored[ident] = version
            final[ident] = (epoch, version)
    return stale, final


def frame(spark, rows):
    return spark.createDataFrame(rows, "mail_id string, epoch_id bigint, action string, event_version bigint")


@pytest.mark.parametrize("block", [None, 1, 7, 16, 1000])
def test_w3_fold_matches_replay(spark, block):
    rows = histories(3)
    stale, _ = replay(rows)
    got = stale_rows(fold_versions(frame(spark, rows), MAIL, block=block)).collect()
    assert {(r.mail_id, r.epoch_id, r.event_version, r.current_version) for r in got} == stale
    assert len(got) == len(stale) > 100


def test_w3_delete_counts_agree(spark):
    df = frame(spark, histories(8, ids=10))
    key = lambda r: (r.mail_id, r.epoch_id, r.delete_count)
    assert sorted(map(key, fold_versions(df, MAIL).collect())) == sorted(
        map(key, fold_versions(df, MAIL, block=9).collect())
    )


def test_w3_final_state_matches_replay(spark):
    for seed in (1, 2):
        rows = histories(seed, deletes=0.3)
        _, final = replay(rows)
        got = final_state(frame(spark, rows), MAIL).collect()
        assert {r.mail_id: (r.epoch_id, r.event_version) for r in got} == final


def test_w3_one_hot_id(spark):
    """One id with far more epochs than any other."""
    rows = [("hot", e, "DELETE" if e % 97 == 0 else "UPSERT", (e * 7) % 50) for e in range(3000)]
    rows += histories(4, ids=5, epochs=20)
    stale, final = replay(rows)
    df = frame(spark, rows)
    assert stale_rows(fold_versions(df, MAIL, block=64)).count() == len(stale)
    assert {r.mail_id: r.epoch_id for r in final_state(df, MAIL).collect()} == {k: v[0] for k, v in final.items()}


def test_gold_state_plan_matches_epoch_by_epoch_replay(spark):
    rng = random.Random(21)
    feeds, live = None, {}
    records = {f"m{i}": ({"title": ""} if i % 5 == 0 else {}) for i in range(12)}
    for epoch in range(6):
        values, best = [], {}
        for i in range(30):
            ident, version = f"m{rng.randrange(15)}", rng.randrange(5)
            action = rng.choice(["x", "x", "x", "delete"])
            values.append(json.dumps({"mail_id": ident, "action": action, "version": version}))
            if ident not in best or (version, i) >= best[ident][:2]:
                best[ident] = (version, i, action)
        for ident, (version, _, action) in best.items():
            if action == "delete":
                live.pop(ident, None)
            elif records.get(ident) == {} and version >= live.get(ident, 0):
                live[ident] = version
        part = feed(spark, values, epoch)
        feeds = part if feeds is None else feeds.unionByName(part)
    src = source(spark, records)
    assert H.renamed_records(src, MAIL).count() == 0
    got = H.gold_state(feeds, src, MAIL).collect()
    assert {r.mail_id: r.event_version for r in got} == live
    assert got[0].title == "Hello"


def test_renamed_records_are_found(spark):
    src = source(spark, {"a": {"id": "b"}, "c": {}})
    assert [tuple(r) for r in H.renamed_records(src, MAIL).collect()] == [("a", "b")]


def test_w3_one_id_is_spread_over_tasks(spark):
    """All rows in one id: runs, and so tasks, share it; the outcome is that of a walk along the epochs."""
    rng = random.Random(8)
    rows = [("hot", e, rng.choice(["UPSERT", "UPSERT", "UPSERT", "DELETE"]), rng.randrange(50)) for e in range(3000)]
    df = spark.createDataFrame(rows, "mail_id string, epoch_id bigint, action string, event_version bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = scan.in_runs(df, ["mail_id"], "epoch_id").groupBy(scan.RUN).count().collect()
        got = {r.epoch_id: (r.delete_count, r.current_version) for r in fold_versions(df, MAIL).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(runs) > 1 and max(r["count"] for r in runs) < 2000
    deletes, best, want = 0, None, {}
    for _, epoch, action, version in rows:
        if action == "DELETE":
            deletes, best = deletes + 1, None
        want[epoch] = (deletes, best)
        if action == "UPSERT":
            best = version if best is None else max(best, version)
    assert got == want


def test_as_of_finds_the_last_place_before(spark):
    rng = random.Random(3)
    left = [(rng.choice(["a", "b", "hot", "hot", "hot", "none"]), rng.randrange(400)) for _ in range(900)]
    right = [(rng.choice(["a", "b", "hot", "hot"]), rng.randrange(400)) for _ in range(150)]
    frames = [spark.createDataFrame(x, "k string, t bigint") for x in (left, right)]
    got = {(r.k, r.t): r.found for r in scan.as_of(*frames, "k", "t").collect()}
    assert got == {(k, t): max((u for j, u in right if j == k and u <= t), default=None) for k, t in left}
    assert scan.as_of(frames[0].where("false"), frames[1], "k", "t").collect() == []
    assert {r.found for r in scan.as_of(frames[0], frames[1].where("false"), "k", "t").collect()} == {None}
