"""The registered queries against their SQL, plans of the native ones, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from tidewell.llm import registered
from tidewell.sources.storage import cut_lineage

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_equals_sql(spark, name):
    got = registered.QUERIES[name](spark, DATA).toPandas()
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = db.execute(registered.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    both = [df[columns].astype(object).where(df[columns].notna(), None).values.tolist() for df in (got, want)]
    assert sorted(map(repr, both[0])) == sorted(map(repr, both[1]))


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_quality_rules"])
def test_native_plans_have_no_python(spark, name):
    plan = registered.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, DATA))
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
