import itertools
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.operators import marts
from panelspark.operators.panel import clean_panel
from panelspark.plans import lineage, pipeline
from panelspark.sources import files, raw_cells, readers, sinks
from panelspark.sources.records import read_pieces


def test_csv_by_name_and_schema(spark, tmp_path):
    (tmp_path / "p.csv").write_text("category,entity,period,total,source,extra\nx,Agra,2016,12,s,9\ny,Etah,bad,3,s,9\n")
    rows = readers.read_csv(spark, str(tmp_path / "p.csv"))
    assert rows.schema == S.PANEL
    assert [tuple(r) for r in rows.orderBy("entity").collect()] == [("Agra", 2016, "x", 12, "s"), ("Etah", None, "y", 3, "s")]


def test_tolerant_scan(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "entity,period,category,total,source\n Agra ,2016, x ,12.9,s\nEtah,20x6,x,3,s\nMau,2017,x,many,s\nBasti,2018,y,-2.5,s\n"
    )
    got = readers.read_tolerant(spark, str(tmp_path / "p.csv")).collect()
    assert {tuple(r) for r in got} == {("Agra", 2016, "x", 12), ("Basti", 2018, "y", -2)}


def test_second_source(spark, tmp_path):
    (tmp_path / "k.csv").write_text("State,District,Year,Crime_Type,Cases_Reported\nUP,Agra,2016,x,4\nMP,Gwalior,2016,x,9\n")
    names = {"District": "entity", "Year": "period", "Crime_Type": "category", "Cases_Reported": "total"}
    df = readers.read_source(spark, str(tmp_path / "k.csv"), names, "second", where={"State": "UP"})
    assert [tuple(r) for r in df.collect()] == [("Agra", "2016", "x", "4", "second")]


def test_optional_input(spark, tmp_path):
    missing = readers.read_optional(spark, str(tmp_path / "none.csv"), S.PREDICTIONS)
    assert missing.schema == S.PREDICTIONS and missing.count() == 0
    missing = readers.read_optional(spark, str(tmp_path / "none.parquet"), S.PANEL, "parquet")
    assert missing.count() == 0
    (tmp_path / "broken.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # only a missing path is optional
        readers.read_optional(spark, str(tmp_path / "broken.parquet"), S.PANEL, "parquet").count()


def test_file_listing(spark, tmp_path):
    for name in ("b/2/x.csv", "b/1/y.txt", "b/z.json", "a.csv", "b.csv"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("1\n")
    names = {r.path.rsplit("/", 1)[1] for r in readers.list_files(spark, str(tmp_path)).collect()}
    assert names == {"x.csv", "y.txt", "a.csv", "b.csv"}
    assert readers.first_file(spark, str(tmp_path)).endswith("/a.csv")


def test_raw_cells_of_split_files(spark, tmp_path):
    """Row numbers stay right when a file is read in many pieces."""
    for f in range(3):
        lines = [f'{i},"name, {i} ""q""",{i * f},' for i in range(4000 + f)]
        (tmp_path / f"s{f}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 9
        df = raw_cells.read_raw_cells(spark, str(tmp_path))
        for f in range(3):
            rows = df.filter(F.col("path").endswith(f"s{f}.csv")).orderBy("row_idx").collect()
            assert [r.row_idx for r in rows] == list(range(4000 + f))
            assert all(r.cells == [str(r.row_idx), f'name, {r.row_idx} "q"', str(r.row_idx * f), ""] for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cells_of_a_line(spark):
    lines = [",a,,b", "", '"x","",y', "a", '"un"closed,z']
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    got = [r[0] for r in df.select(raw_cells.split_cells(F.col("l"))).collect()]
    assert got[:4] == [["", "a", "", "b"], [""], ["x", "", "y"], ["a"]]


def test_sheets_to_panel_on_disk(spark, tmp_path, panel_of):
    (tmp_path / "2019").mkdir()
    (tmp_path / "2019" / "IPC.csv").write_text("State: Bihar,,\n1,Patna,3\nState: Uttar Pradesh,,\n1,Agra,10\n2,Total,10\n")
    raw = raw_cells.read_raw_cells(spark, str(tmp_path))
    df = pipeline.build_panel(raw, "Uttar Pradesh", panel_of([("Etah", "x", 2018, 7)]))
    assert {(r.entity, r.category, r.period, r.total, r.source) for r in df.collect()} == {
        ("Agra", "IPC Crimes", 2019, 10, "sheets"), ("Etah", "x", 2018, 7, "s"),
    }
    sinks.write_panel(df, str(tmp_path / "panel"))
    back = spark.read.parquet(str(tmp_path / "panel"))
    assert back.count() == 2
    scan = back.filter("period = 2018")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in scan


def test_json_rows_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    sinks.write_json_rows(df, str(tmp_path / "j"))
    text = "".join(f.read_text() for f in (tmp_path / "j").glob("part-*.json"))
    assert json.loads(text) == {"k": "a", "v": None}


def test_written_analyses(spark, tmp_path, panel_of):
    df = panel_of([(e, c, y, (y % 7) * 10 + len(e)) for e in ("A", "BB", "CCC") for c in "xyz" for y in range(2015, 2021)])
    out = pipeline.analyses(df, pipeline.default_lookup(spark), (2019, 2020), 2017, cells=pipeline.panel_cells(df))
    names = ("entity_ranking", "report_cards", "compare_periods", "category_trend")
    pipeline.write_analyses({n: out[n] for n in names}, str(tmp_path), first=2015, last=2020, before=2019, after=2020)
    back = spark.read.option("header", True).csv(str(tmp_path / "entity_ranking"))
    assert back.columns == ["District", "Total_All_Years", "Rank"] and [r["Rank"] for r in back.collect()] == ["1", "2", "3"]
    compared = spark.read.option("header", True).csv(str(tmp_path / "compare_periods"))
    assert marts.find_column(compared, "2019") == "Pre_COVID_2019" and marts.find_column(compared, "2020") == "During_COVID_2020"
    assert {"2015_count", "2020_count"} <= set(spark.read.option("header", True).csv(str(tmp_path / "category_trend")).columns)


def test_files_of_different_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('entity,period,category,total,source\n"A, ""x""",2014.0,c,12.0,s\nB,2015,c,abc,s\nC,2016.5,c,3,s\n')
    (tmp_path / "b.csv").write_text("total,source,entity,period\n9007199254740993,t,D,2017\n,t,E,2018\n")
    got = sorted(map(tuple, readers.read_csv(spark, str(tmp_path)).collect()))
    assert got == [
        ('A, "x"', 2014, "c", 12, "s"), ("B", 2015, "c", None, "s"), ("C", None, "c", 3, "s"),
        ("D", 2017, None, 9007199254740993, "t"), ("E", 2018, None, None, "t"),
    ]
    panel = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert {(r.entity, r.total) for r in clean_panel(panel, missing="zero").collect()} == {('A, "x"', 12), ("B", 0), ("C", 3)}
    assert {r.entity for r in clean_panel(panel).collect()} == {'A, "x"'}


def test_geojson(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 0]], [[9, 9], [8, 8], [9, 9]]]}
    multi = {"type": "MultiPolygon", "coordinates": [[[[4, 0], [5, 1.5], [4, 0]]], [[[6, 2], [7, 3], [6, 2]]]]}
    features = [
        {"type": "Feature", "properties": {"Dist_Name": "Kheri", "n": 3}, "geometry": square},
        {"type": "Feature", "properties": {"Dist_Name": "", "NAME_2": "Agra"}, "geometry": multi},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(f) for f in features))
    from panelspark.operators import geometry

    for df in (
        readers.read_geojson(spark, str(tmp_path / "g.geojson")),
        readers.read_geojson(spark, str(tmp_path / "lines.json"), one_per_line=True),
    ):
        shapes = geometry.shapes(df)
        got = {r.name: (r.entity, [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in shapes.collect()}
        assert got == {
            "Kheri": ("Khiri", [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]]),
            "Agra": ("Agra", [[(4.0, 0.0), (5.0, 1.5), (4.0, 0.0)], [(6.0, 2.0), (7.0, 3.0), (6.0, 2.0)]]),
        }
        assert {r.name: len(r.path_rings) for r in shapes.collect()} == {"Kheri": 2, "Agra": 2}
        paths = {r.name: r.path for r in geometry.feature_paths(geometry.project(shapes)).collect()}
        assert {n: p.count("M") for n, p in paths.items()} == {"Kheri": 2, "Agra": 2}


def test_materialised_tables_live_in_the_named_folder(spark):
    folder = Path(lineage.shared_folder(spark).removeprefix("file:"))
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or folder == Path(named.removeprefix("file:"))
    before = set(folder.glob("panelspark-*"))
    with lineage.RunFolder(spark) as run:
        assert lineage.materialise(spark.range(3), run).count() == 3
    assert set(folder.glob("panelspark-*")) == before
    df = lineage.materialise(spark.range(5).withColumn("m", F.lit(None).cast("int")))
    assert df.schema.names == ["id", "m"] and df.count() == 5
    assert len(set(folder.glob("panelspark-*")) - before) == 1
    scan = df.select("id").filter("id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in scan


def test_job_end_to_end(spark, tmp_path):
    from panelspark.plans import job

    for year in range(2016, 2023):
        folder = tmp_path / "sheets" / str(year)
        folder.mkdir(parents=True)
        for n, name in enumerate(("IPC", "SLL")):
            body = "".join(f"{i},d{i},{year - 2000 + i * 7 + n}\n" for i in range(1, 6))
            (folder / f"{name}.csv").write_text(f"State: Bihar,,\n1,Patna,3\nState: Uttar Pradesh,,\n{body},Total,99\n")
    (tmp_path / "second.csv").write_text(
        "State,District,Year,Crime_Type,Cases_Reported\n"
        + "".join(f"Uttar Pradesh,d{i},{y},Theft,{i * 3 + y % 5}\nBihar,Patna,{y},Theft,1\n" for i in range(1, 4) for y in range(2014, 2023))
    )
    out = tmp_path / "out"
    argv = ["--sheets", str(tmp_path / "sheets"), "--section", "Uttar Pradesh", "--second", str(tmp_path / "second.csv"),
            "--out", str(out), "--trees", "5"]
    job.run(spark, job.parse(argv))
    panel = spark.read.parquet(str(out / "panel"))
    assert panel.count() == 7 * 2 * 5 + 3 * 9
    cards = spark.read.option("header", True).csv(str(out / "analysis" / "report_cards"))
    assert cards.count() == 5 and "Recent_Trend_pct" in cards.columns
    predictions = spark.read.option("header", True).csv(str(out / "model" / "predictions"))
    assert predictions.count() == 13 and {"Change_cases", "Actual_2022", "Predicted_2023"} <= set(predictions.columns)
    for name in ("metrics", "importance", "by_entity", "compare", "by_category"):
        assert spark.read.option("header", True).csv(str(out / "model" / name)).count() > 0 or name == "importance"
    for name in ("kpis", "latest_top", "heatmap", "category_share", "lowest_entities", "top_intensity", "risk_distribution", "ranking_bars"):
        assert spark.read.option("header", True).csv(str(out / "dashboard" / name)).count() > 0
    assert spark.read.json(str(out / "dashboard" / "entity_profiles")).count() == 5
    audit = spark.read.option("header", True).csv(str(out / "audit"))
    assert {r.status for r in audit.collect()} == {"OK"} and audit.count() == 14


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    """A task for each folder would send the driver more about itself than about files."""
    for i in range(200):
        (tmp_path / f"k={i}").mkdir()
        (tmp_path / f"k={i}" / "a.csv").write_text("x\n")
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting, None)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        listed = files.list_files(spark, str(tmp_path))
        read_pieces(spark, str(tmp_path), recursive=True)
        tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tasks) == 2 and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert listed.count() == 200 and spark.conf.get(setting, None) == before


@pytest.mark.parametrize("local", [True, False])
def test_a_text_file_for_each_sheet(spark, tmp_path, monkeypatch, local):
    """Both writers give the same files; the tasks' own leaves no drafts, and no file is written twice."""
    if not local:
        monkeypatch.setattr(sinks, "_local_path", lambda spark, path: None)
    sheets_ = {(2015 + k % 2, f"k{k}" if k else None): [f"{k},{i}" for i in range(1 + 40 * (k % 3))] for k in range(30)}
    rows = [(y, k, i, v) for (y, k), lines in sheets_.items() for i, v in enumerate(lines)]
    df = spark.createDataFrame(rows[::-1], "year int, key string, line int, value string").repartition(3, "key")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        sinks.write_texts(df, f"file://{tmp_path}/out", ("year", "key"), ("key", "line"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = [p for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]
    got = {(p.parent.parent.name, p.parent.name): p.read_text().splitlines() for p in found}
    assert len(found) == len(got) == 30
    assert got == {(f"year={y}", f"key={k or '__HIVE_DEFAULT_PARTITION__'}"): lines for (y, k), lines in sheets_.items()}
    if local:
        assert not [p for p in (tmp_path / "out").rglob(".*")]


def test_lines_are_counted_and_looked_through_at_once(spark, tmp_path):
    """Raw cells take one more scan of the text than reading it: the counts are a table."""
    (tmp_path / "a.csv").write_text('1,"a, b"\n2,"c"\n')
    plan = raw_cells.read_raw_cells(spark, str(tmp_path), named=lambda p: F.substring_index(p, "/", -1))
    assert [(r.path, r.row_idx, r.cells) for r in plan.orderBy("row_idx").collect()] == [("a.csv", 0, ["1", "a, b"]), ("a.csv", 1, ["2", "c"])]
    scans = plan._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count(" text") == 1 and scans.count(" parquet") == 1


def test_cells_with_and_without_a_pattern(spark):
    """Records of all forms up to five signs: those that need no pattern give the pattern's cells."""
    lines = ["".join(x) for n in range(6) for x in itertools.product('",a\0', repeat=n)]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    got = {r.l: r.c for r in df.select("l", raw_cells.split_cells(F.col("l")).alias("c")).collect()}

    def cells(line):
        parts = re.findall(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)', "," + line)
        return [p[1:-1].replace('""', '"') if len(p) > 1 and p[0] == p[-1] == '"' else p for p in parts]

    assert got == {x: cells(x) for x in lines}
