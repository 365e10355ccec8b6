import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators.ordered import ordered_index, sort_nulls_last, top_k_per_group, top_n


@pytest.mark.parametrize("buckets", [2, 7, 33, 100, 256, None])
def test_index_equals_sorting(spark, buckets):
    rng = random.Random(buckets or 1)
    # A third of the rows share one value, so the order among them hangs on the name.
    rows = [(f"k{i:05d}", 0 if rng.random() < 0.34 else rng.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "name string, v bigint").repartition(5)
    got = {r.name: r["rank"] for r in ordered_index(df, desc="v", asc=["name"], buckets=buckets).collect()}
    want = {n: i for i, (n, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_index_of_equal_keys_and_empty_input(spark):
    same = spark.createDataFrame([(1, "a")] * 50, "v bigint, name string")
    assert sorted(r["rank"] for r in ordered_index(same, desc="v", asc=["name"], buckets=4).collect()) == list(range(1, 51))
    assert ordered_index(same.filter("v > 1"), desc="v", asc=["name"]).count() == 0


def test_index_balances_its_ranges(spark):
    """No range gets a large part of the rows even when one value holds most of them."""
    df = spark.range(20000).select(F.lit(0).cast("bigint").alias("v"), F.col("id").cast("string").alias("name"))
    key = F.struct((-F.col("v")).alias("d"), F.col("name").alias("a0"))
    keyed = df.withColumn("_key", key)
    sample = [r[0] for r in keyed.orderBy(F.xxhash64("_key")).limit(255).select("_key.a0").collect()]
    sample.sort()
    names = sorted(r.name for r in df.collect())
    import bisect

    sizes = [0] * 256
    for n in names:
        sizes[bisect.bisect_left(sample, n)] += 1
    assert max(sizes) < 20000 / 256 * 10
    got = {r.name: r["rank"] for r in ordered_index(df, desc="v", asc=["name"]).collect()}
    assert got == {n: i for i, n in enumerate(names, 1)}


def test_top_k_trims_before_the_shuffle(spark):
    rows = [("hot", f"c{i:04d}", i % 97) for i in range(3000)] + [("cold", "x", 1), ("cold", "y", 1)]
    df = spark.createDataFrame(rows, "g string, c string, v bigint").repartition(6)
    top = top_k_per_group(df, ["g"], "v", ["c"], 3)
    assert {(r.g, r.c, r["rank"]) for r in top.collect()} == {
        ("hot", "c0096", 1), ("hot", "c0193", 2), ("hot", "c0290", 3), ("cold", "x", 1), ("cold", "y", 2),
    }
    plan = top._jdf.queryExecution().executedPlan().toString()
    # Once inside each task, once after the shuffle.
    assert plan.split("== Initial Plan ==")[0].count("WindowGroupLimit") == 2


def test_sorting_and_top_n(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 1.0)], "k string, v double")
    assert [r.k for r in sort_nulls_last(df, "-v", "k").collect()] == ["c", "a", "d", "b"]
    assert [r.k for r in sort_nulls_last(df, "v", "-k").collect()] == ["d", "a", "c", "b"]
    assert [r.k for r in top_n(df, "v", 2, ["k"]).collect()] == ["c", "a"]
    assert [r.k for r in top_n(df, "v", 2, ["k"], ascending=True).collect()] == ["a", "d"]
