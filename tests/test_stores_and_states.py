"""The table store, jobs run together, inferred types and mergeable distinct counts."""

import random
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import distinct, inference
from panelspark.operators.panel import panel_overview
from panelspark.plans import lineage, pipeline
from panelspark.plans.concurrent import run_together
from panelspark.plans.store import TableStore, plan_key
from panelspark.sources import readers


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def fact(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.range(100).select("id", (F.col("id") % 7).alias("k")).write.parquet(path)
    return path


def summed(spark, path, least=0):
    return spark.read.parquet(path).filter(F.col("id") >= least).groupBy("k").agg(F.sum(F.col("id") * 2).alias("s"))


def test_store_reads_what_it_has(spark, tmp_path, fact):
    store = TableStore(spark, str(tmp_path / "store"))
    first = store.load(summed(spark, fact))
    want = sorted(map(tuple, summed(spark, fact).collect()))
    again = TableStore(spark.newSession(), str(tmp_path / "store")).load(summed(spark.newSession(), fact))
    assert first.inputFiles() == again.inputFiles() and str(tmp_path / "store") in again.inputFiles()[0]
    assert "fact" not in plan_text(again) and sorted(map(tuple, again.collect())) == want
    other = store.load(summed(spark, fact, least=50))  # another plan
    assert other.inputFiles() != first.inputFiles() and sorted(map(tuple, first.collect())) == want
    assert store.load(summed(spark, fact), version="2").inputFiles() != first.inputFiles()


def test_store_sees_changed_files(spark, tmp_path, fact):
    store = TableStore(spark, str(tmp_path / "store"))
    first = store.load(summed(spark, fact))
    spark.range(100, 110).select("id", (F.col("id") % 7).alias("k")).write.mode("append").parquet(fact)
    second = store.load(summed(spark, fact))
    assert second.inputFiles() != first.inputFiles()
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, summed(spark, fact).collect()))
    with pytest.raises(Exception):  # the stale table is gone
        spark.read.parquet(first.inputFiles()[0]).count()
    store.forget(summed(spark, fact))
    with pytest.raises(Exception):
        spark.read.parquet(second.inputFiles()[0]).count()


def test_store_leaves_nothing_of_a_failed_run(spark, tmp_path, fact):
    store = TableStore(spark, str(tmp_path / "store"))
    failing = spark.read.parquet(fact).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("x"))
    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            store.load(failing)
    store.clear()
    assert not (tmp_path / "store").exists()


def test_keys_tell_plans_apart(spark, tmp_path, fact):
    csv = str(tmp_path / "c")
    spark.range(5).write.csv(csv)
    keys = {plan_key(df) for df in (spark.read.csv(csv), spark.read.option("header", True).csv(csv), spark.read.option("sep", ";").csv(csv))}
    assert len(keys) == 3
    wide = spark.read.parquet(fact).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)])
    changed = spark.read.parquet(fact).select(*[(F.col("id") + (i if i < 59 else 0)).alias(f"c{i}") for i in range(60)])
    assert plan_key(wide) != plan_key(changed)
    lists = lambda n: spark.read.parquet(fact).select(F.transform(F.array("id", "k"), lambda x: x + n).alias("l"))
    assert plan_key(lists(1)) == plan_key(lists(1)) != plan_key(lists(2))
    with pytest.raises(ValueError, match="in no file"):
        plan_key(spark.createDataFrame([(1,)], "a int"))


def test_a_folder_must_be_named(spark, monkeypatch):
    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "local[2]"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Bare)


# Jobs run together


def test_jobs_overlap_and_return(spark):
    running, most, lock = [0], [0], threading.Lock()

    def job(i):
        def work():
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            n = spark.range(1000 * i).count()
            time.sleep(0.3)
            with lock:
                running[0] -= 1
            return n

        return work

    assert run_together(spark, {f"j{i}": job(i) for i in range(1, 8)}, at_once=3) == {f"j{i}": 1000 * i for i in range(1, 8)}
    assert most[0] == 3
    assert run_together(spark, {}, at_once=3) == {}


def test_one_failure_ends_all(spark):
    started = []

    def slow():
        started.append(1)
        spark.range(64).repartition(64).foreach(lambda r: time.sleep(2))

    def fails():
        time.sleep(1)
        raise KeyError("first")

    began = time.time()
    with pytest.raises(KeyError, match="first"):
        run_together(spark, {"a": slow, "b": fails, "c": slow, "d": slow}, at_once=2)
    assert time.time() - began < 12 and len(started) <= 2
    assert spark.range(3).count() == 3


def test_tables_written_together(spark, tmp_path, panel_of):
    df = panel_of([(e, c, y, (y % 7) * 10 + len(e)) for e in ("A", "BB", "CCC") for c in "xyz" for y in range(2015, 2021)])
    out = pipeline.analyses(df, pipeline.default_lookup(spark), (2019, 2020), 2017, cells=pipeline.panel_cells(df))
    names = ("entity_ranking", "report_cards", "concentration", "kpis", "peak_best")
    for at_once in (1, 4):
        pipeline.write_analyses({n: out[n] for n in names}, str(tmp_path / str(at_once)), rename=False, at_once=at_once)
    for n in names:
        rows = [sorted(f.read_text() for f in (tmp_path / str(i) / n).glob("part-*.csv")) for i in (1, 4)]
        assert rows[0] == rows[1] and rows[0]


# Types


def pandas_kind(values):
    kind = pd.Series(pd.read_csv(pd.io.common.StringIO("c\n" + "".join(f'"{v}"\n' for v in values)))["c"]).dtype
    return {"int64": "bigint", "float64": "double", "bool": "boolean"}.get(str(kind), "string")


def test_inferred_types_equal_a_reader(spark):
    columns = {
        "whole": ["1", "-2", "+3"], "gap": ["1", "", "3"], "dec": ["1", "2.5", ".5"], "exp": ["1e5", "-3.E-2", "7"], "inf": ["inf", "-Infinity", "1"],
        "na": ["NA", "null", "n/a"], "mixed": ["1", "x", "2"], "bools": ["True", "false", "TRUE"], "boolgap": ["True", "", "False"],
        "boolnum": ["True", "1", "0"], "text": ["a", "b", ""], "comma": ["1,000", "2", "3"], "hex": ["0x1", "2", "3"], "blank": [" 1", "2 ", "3"],
        "odd": ["1_0", "2", "3"], "nan": ["nan", "1", "-nan"],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    got = {r["column"]: r["type"] for r in inference.inferred_types(df).collect()}
    assert got == {c: pandas_kind(v) for c, v in columns.items()}
    large = spark.createDataFrame([("9223372036854775807", "9223372036854775808")], "a string, b string")
    assert [r["type"] for r in inference.inferred_types(large).collect()] == ["bigint", "string"]
    empty = inference.inferred_types(df.limit(0)).collect()
    assert {r["type"] for r in empty} == {"string"} and {r["rows"] for r in empty} == {0}


def test_states_of_parts_merge(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["1", "", "x"]), rnd.choice(["1", "2"]), rnd.choice(["1.5", "2", "NA"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, `c.d` string").withColumn("part", F.monotonically_increasing_id() % 5)
    parts = [inference.column_states(df.filter(F.col("part") == i).drop("part")) for i in range(5)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    assert sorted(map(tuple, inference.merge_states(merged).collect())) == sorted(map(tuple, inference.column_states(df.drop("part")).collect()))
    plan = plan_text(inference.column_states(df.drop("part")))
    assert plan.count("HashAggregate(keys=[]") == 2 and "Expand" not in plan


def test_read_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,"c.d",e\n1,x,,"two\nlines"\n2,NA,2.5,\n')
    (tmp_path / "b.csv").write_text("b,a\nnull,3\n")
    out = readers_inferred = inference.read_inferred(spark, str(tmp_path))
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c.d": "double", "e": "string"}
    rows = sorted(map(tuple, readers_inferred.select("a", "b", "`c.d`", "e").collect()))
    assert rows == [(1, "x", None, "two\nlines"), (2, None, 2.5, None), (3, None, None, None)]
    (tmp_path / "none").mkdir()
    assert readers.read_text_columns(spark, str(tmp_path / "none")).columns == []


# Distinct counts


def test_bitmaps_count_and_merge(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, *range(90_000)]) if rnd.random() < 0.9 else 7, rnd.choice(["a", "b", None])) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "period int, entity int, category string")
    keys = ["entity", "category"]
    bitmaps = distinct.distinct_bitmaps(df, keys, by=["period"])
    assert bitmaps.groupBy("column", "period").count().filter("column = 'entity'").first()["count"] >= 2  # several buckets
    at = lambda keep: tuple(len({r[i] for r in rows if keep(r[0]) and r[i] is not None}) for i in (1, 2))
    got = {r.period: (r.entity, r.category) for r in distinct.count_distinct(bitmaps, keys, by=["period"]).collect()}
    assert got == {p: at(lambda x: x == p) for p in (None, 1, 2, 3)}
    assert tuple(distinct.count_distinct(bitmaps, keys).first()) == at(lambda x: True)
    known = distinct.distinct_bitmaps(df.filter("period is not null"), keys, by=["period"])
    so_far = {r.period: (r.entity, r.category) for r in distinct.running_distinct(known, keys, "period").collect()}
    assert so_far == {p: at(lambda x: x is not None and x <= p) for p in (1, 2, 3)}


def test_overview_expands_no_row(spark, panel_of):
    df = panel_of([("A", "x", 2001, 5), ("A", "y", 2001, 6), ("B", "x", 2003, None), ("A", "x", 2001, 1)])
    out = panel_overview(df)
    assert tuple(out.first()) == (4, 2, 2, 2, 2001, 2003, 12)
    assert "Expand" not in plan_text(out) and "NestedLoop" not in plan_text(out)
    assert tuple(panel_overview(df.limit(0)).first()) == (0, 0, 0, 0, None, None, None)
    assert np.isfinite(out.first()["total"])
