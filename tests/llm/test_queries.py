"""Registered queries against their SQL, and the shape of native plans."""

import duckdb
import pytest

from panelspark.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    relation = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(repr(r[i]) for i in at) for r in relation.fetchall())
    assert sorted(tuple(repr(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["op2_contaminated", "op7_licences", "op8_kd_shards"])
def test_native_plans_run_no_python(spark, name):
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_names():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
