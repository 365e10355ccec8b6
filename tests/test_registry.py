"""Every registered query against its SQL, and the shape of the plans."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
# Fits of models without an equivalent in SQL; test_forecast covers them.
ROWS_ONLY = {"model_compare", "model_card", "feature_importance"}
# Queries whose large side must not be joined on a few hot keys, and these keys.
HOT_KEYS = {"intensity_by_period": "period", "risk_level": "period", "lag_features": "category", "choropleth": "_e"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def normal(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", sorted(registry.panel_oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.panel_queries()[name](spark, FOLDER)
    sql = registry.panel_oracle_sql()[name]
    relation = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SPARK_TYPES[t] for c, t in df.dtypes} == kinds
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(normal(r[i]) for i in at) for r in relation.fetchall())
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_only_fits_lack_an_oracle():
    assert set(registry.panel_queries()) - set(registry.panel_oracle_sql()) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(HOT_KEYS))
def test_large_sides_are_not_dealt_by_few_keys(spark, name):
    """Without broadcast joins: no join on a period, category or label alone, as a large input would have."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.panel_queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
        assert HOT_KEYS[name] not in {re.sub(r"#\d+L?", "", k) for k in keys}, keys
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_entry(spark):
    assert registry.entry(spark).columns == ["entity", "total", "rank"]


def executed_scans(spark, column):
    """Row counters of the scans of the last query that read ``column``'s table and really ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values = store.executionMetrics(last)
    nodes = store.planGraph(last).allNodes()
    counters = {}
    for i in range(nodes.size()):
        node = nodes.apply(i)
        if node.name().startswith("Scan parquet") and column in node.desc():
            for j in range(node.metrics().size()):
                m = node.metrics().apply(j)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    counters[m.accumulatorId()] = (values.apply(m.accumulatorId()), node.desc())
    return list(counters.values())


@pytest.mark.parametrize(
    "name",
    ["supplier_ranking", "supplier_signature", "concentration", "report_card", "intensity_by_period", "category_trend",
     "latest_top10", "top10_semi_series", "entity_profile_json", "sheet_extract"],
)
def test_facts_are_scanned_once_and_pruned(spark, name):
    """Analyses that use a cube several times still read the fact table once."""
    registry.panel_queries()[name](spark, FOLDER).collect()
    scans = executed_scans(spark, "l_orderkey")
    assert len(scans) == 1
    assert "l_extendedprice" not in scans[0][1] and "l_shipdate" not in scans[0][1]
