"""Every registered query against its SQL in DuckDB, on whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidewell.plans.comparison import SQL
from tidewell.plans.queries import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def normal(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert got, name
    if name in SQL:
        rel = duck.execute(SQL[name])
        names = [d[0] for d in rel.description]
        want = rel.fetchall()
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, got) == rows_of(names, want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_every_message_occurs(spark):
    """V1-V11, the lookup errors, the cleaning errors and stale versions are all reached by whole tables."""
    reasons = {r[0] for r in QUERIES["validate_reasons"](spark, DATA).select("rule_error").distinct().collect()}
    heads = (
        "mail_id is required", "title is required", "body is required", "sender is required", "invalid sender email: ",
        "receiver is required", "invalid receiver email: ", "invalid cc email: ", "invalid sent_at datetime: ",
        "read_yn must be boolean", "has_attachment must be boolean",
    )
    for head in heads:
        assert any(r and r.startswith(head) for r in reasons), head
    held = {r[0] for r in QUERIES["quarantine_union"](spark, DATA).select("validation_error").distinct().collect()}
    for head in ("fetch failed: timeout", "supply response error: gone", "supply response error: not found", "stale event dropped"):
        assert any(r.startswith(head) for r in held), head
    # all records, not only those the batch asks for, also fail cleaning
    for head in ("body is empty after refinement", "title is empty after refinement"):
        assert any(r.startswith(head) for r in held), head
