"""Records of split files against readers that see a file whole."""

import csv
import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import geometry, sheets
from panelspark.sources import files, readers, records
from panelspark.sources.raw_cells import read_raw_cells, split_cells


@pytest.fixture
def small_splits(spark):
    """Files cut every 2 KB."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def written(rows, **options):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", **options).writerows(rows)
    return out.getvalue()


def broken_rows(seed, n):
    """Rows whose cells hold breaks, quotes and commas, some longer than several splits."""
    rnd = random.Random(seed)
    texts = ["Old\nTown", 'a "q" b', "x,y", "", "\n", "\n\n", '"', '",\n"', "plain", "é", 'tail"', "1.5", '",', "a\n" * 4]
    return [[str(i), rnd.choice(texts), rnd.choice(texts), "z" * rnd.choice([0, 3, 90])] for i in range(n)]


def cells(spark, path, **options):
    rows = read_raw_cells(spark, str(path), **options).orderBy("path", "row_idx").collect()
    out = {}
    for r in rows:
        out.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_idx, r.cells))
    return out


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_records_of_split_files(spark, tmp_path, small_splits, quoting):
    files_ = {f"b{i}.csv": broken_rows(i, 300) for i in range(3)}
    files_["plain.csv"] = [[str(i), "a", "b", "c"] for i in range(900)]
    files_["long.csv"] = [["1", "x\n" * 9000, "y", "z"], ["2", "n" * 9000, "y", "z"], ["3", "", "", ""]]
    for name, rows in files_.items():
        (tmp_path / name).write_text(written(rows, quoting=quoting))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = cells(spark, tmp_path)
    for name, rows in files_.items():
        assert got[name] == list(enumerate(rows)), name


def test_quotes_that_open_nothing(spark, tmp_path, small_splits):
    """Quotes within a cell are text, and one that is never closed takes no other line."""
    body = [f'{i},5" pipe,"x" y,{"w" * 60}' for i in range(100)]
    (tmp_path / "a.csv").write_text("\n".join([*body, '1,"two\nlines",3', *body]) + "\n")
    plain = [f"{i},pipe,{'w' * 60}" for i in range(100)]
    (tmp_path / "b.csv").write_text("\n".join([*body, '1,"two\nlines",3', '9,"open', *plain]) + "\n")
    (tmp_path / "c.csv").write_text("")
    got = cells(spark, tmp_path)
    assert [i for i, _ in got["a.csv"]] == list(range(201)) and [i for i, _ in got["b.csv"]] == list(range(202))
    assert got["a.csv"][100][1] == ["1", "two\nlines", "3"] == got["b.csv"][100][1]
    assert got["a.csv"][150][1][:2] == ["49", '5" pipe'] and got["b.csv"][101][1] == ["9", '"open']
    assert got["b.csv"][150][1][:2] == ["48", "pipe"]


def test_lines_map_states_like_a_reader(spark):
    """What a line makes of either state, against a reader going through its characters."""

    def after(line, inside):
        at_start = not inside
        i = 0
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside = False
            elif c == '"' and at_start:
                inside = True
            at_start = c == "," and not inside
            i += 1
        return int(inside)

    rnd = random.Random(2)
    lines = ["".join(rnd.choice('",ab') for _ in range(rnd.randrange(12))) for _ in range(3000)] + ['"' + "a" * 50_000, '""' * 20_000]
    df = records._quoting(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.a, r.b) for r in df.collect()] == [(after(x, False), after(x, True)) for x in lines]


def test_cells_of_any_length(spark):
    value = '"' + 'x""' * 30_000 + '",' + "y" * 100_000
    (row,) = spark.createDataFrame([(value,)], "v string").select(split_cells(F.col("v")).alias("c")).collect()
    assert row.c == ['x"' * 30_000, "y" * 100_000]


def test_csv_with_line_breaks(spark, tmp_path, small_splits):
    rows = [[t if "\n" in t or t.strip() else "k", str(2000 + i % 9), "c" * 20, str(i), ""] for i, (_, t, _, _) in enumerate(broken_rows(7, 400))]
    (tmp_path / "a.csv").write_text(written([["entity", "period", "category", "total", "source"], *rows]))
    (tmp_path / "b.csv").write_text("total,entity,period\n7,\"New\nTown\",2001\n\n")
    got = readers.read_csv(spark, str(tmp_path)).orderBy("total").collect()
    want = sorted([(e, int(p), c, int(t), None) for e, p, c, t, _ in rows] + [("New\nTown", 2001, None, 7, None)], key=lambda r: r[3])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    unasked = readers.read_csv(spark, str(tmp_path / "b.csv"), line_breaks=False)
    assert sorted((r.entity, r.total) for r in unasked.collect()) != [("New\nTown", 7)]


@pytest.mark.parametrize(("batch", "broadcast"), [(7, 500_000), (1, 500_000), (50, 0)])
def test_records_over_batches_and_splits(spark, tmp_path, small_splits, monkeypatch, batch, broadcast):
    """Records that end in later batches of their task, and splits that are too many for a broadcast."""
    monkeypatch.setattr(records, "_BROADCAST_SPLITS", broadcast)
    files_ = {f"b{i}.csv": broken_rows(10 + i, 60) for i in range(3)} | {"long.csv": [["1", "x\n" * 3000, "y", "z"], ["2", "", "", ""]]}
    for name, rows in files_.items():
        (tmp_path / name).write_text(written(rows))
    tail = [[str(i), "t"] for i in range(20)]
    (tmp_path / "open.csv").write_text(written(files_["b1.csv"]) + '9,"open\n' + written(tail))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = cells(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for name, rows in files_.items():
        assert got[name] == list(enumerate(rows)), name
    assert got["open.csv"] == list(enumerate([*files_["b1.csv"], ["9", '"open'], *tail]))


def test_lines_of_broken_files_are_not_shuffled(spark, tmp_path):
    """Lines go to records in the task that reads them: no window, sort or exchange of lines but those on split borders."""
    (tmp_path / "a.csv").write_text(written(broken_rows(3, 200)))
    df = records.cut_records(records.read_pieces(spark, str(tmp_path)))
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Window" in x and "value#" in x] and not [x for x in plan if "Window" in x and ", id#" in x]
    assert sum("MapInArrow" in x for x in plan) >= 2


def test_lines_without_breaks_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"a, b"\n2,"c"\n')
    plan = read_raw_cells(spark, str(tmp_path))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert "SortMergeJoin" not in final and "BroadcastHashJoin" in final


# Paths


def test_paths_with_odd_characters(spark, tmp_path):
    names = ["with blank/2015/IPC.csv", "50%/2016/IPC.csv", "é+ü/2017/IPC.csv", "br[1]{a}/2018/IPC.csv"]
    for i, name in enumerate(names):
        f = tmp_path / "sheets" / name
        f.parent.mkdir(parents=True)
        f.write_text(f"State: X,,\n1,Agra {i},{i + 3}\n")
    root = str(tmp_path / "sheets")
    listed = {r.path for r in files.list_files(spark, root).collect()}
    assert {p.split("/sheets/")[1] for p in listed} == set(names)
    raw = read_raw_cells(spark, root)
    assert {r.path for r in raw.select("path").distinct().collect()} == listed
    rows = sheets.extract_sections(raw, "X")
    audit = sheets.load_audit(files.list_files(spark, root), rows, faults=files.file_faults(spark, root)).collect()
    assert {(r.path.split("/sheets/")[1], r.status, r.rows) for r in audit} == {(n, "OK", 1) for n in names}


def test_csv_files_with_odd_names_and_two_headers(spark, tmp_path):
    root = tmp_path / "my data 100%"
    root.mkdir()
    (root / "a b+é.csv").write_text("entity,period,category,total,source\nA,2001,c,1,s\n")
    (root / "c{d}[e].csv").write_text("total,entity,period\n2,B,2002\n")
    got = readers.read_csv(spark, str(root)).orderBy("total").collect()
    assert [(r.entity, r.period, r.total) for r in got] == [("A", 2001, 1), ("B", 2002, 2)]
    assert readers.read_csv(spark, files.first_file(spark, str(root))).first().entity == "A"


def test_heads_read_a_few_bytes(spark, tmp_path):
    (tmp_path / "big.csv").write_text('a,"b\nc"\n' + "1,2\n" * 500_000)
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("x,y\n1,2\n")
    heads = {r.path.rsplit("/", 1)[1]: r.head for r in files.file_heads(files.listing(spark, str(tmp_path))).collect()}
    assert heads == {"big.csv": 'a,"b\nc"', "z.csv.gz": "x,y"}
    read = []
    real = files._opened

    class Counting:
        def __init__(self, uri):
            self.source = real(uri)

        def __enter__(self):
            return self

        def __exit__(self, *error):
            self.source.close()

        def read(self, n):
            data = self.source.read(n)
            read.append(len(data))
            return data

    files._opened = Counting
    try:
        assert files._head(f"file://{tmp_path}/big.csv") == ('a,"b\nc"', None)
    finally:
        files._opened = real
    assert sum(read) <= files._CHUNK


def test_a_broken_file_ends_no_load(spark, tmp_path):
    for year in (2015, 2016):
        (tmp_path / str(year)).mkdir()
        with gzip.open(tmp_path / str(year) / "IPC.csv.gz", "wt") as f:
            f.write("State: X,,\n" + "".join(f"{i},Town {i} {random.Random(i).random()},{i}\n" for i in range(5000)))
    whole = (tmp_path / "2016" / "IPC.csv.gz").read_bytes()
    (tmp_path / "2016" / "IPC.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "2017").mkdir()
    (tmp_path / "2017" / "IPC.csv").write_text("State: X,,\n1,Agra,3\n")
    with pytest.raises(Exception):
        read_raw_cells(spark, str(tmp_path)).count()
    faults = files.file_faults(spark, str(tmp_path))
    raw = read_raw_cells(spark, str(tmp_path), faults=faults)
    rows = sheets.extract_sections(raw, "X")
    audit = sheets.load_audit(files.list_files(spark, str(tmp_path)), rows, faults=faults).orderBy("period").collect()
    assert [(r.period, r.status, r.rows) for r in audit] == [(2015, "OK", 5000), (2016, "FAIL", 0), (2017, "OK", 1)]
    assert audit[1].reason.startswith("cannot be read: ") and len(audit[1].reason) > 20
    with pytest.raises(Exception, match="2016"):
        readers.read_csv(spark, str(tmp_path / "2016")).count()


# GeoJSON


def document(seed, n, indent=None, **members):
    rnd = random.Random(seed)
    names = ['Agra', 'A "q" {b}', 'back\\slash}', '}{][', 'é,"features":[', "\\\"", "a\nb"]
    features = [
        {
            "type": "Feature",
            "properties": {"Dist_Name": f"{rnd.choice(names)}{i}", "nested": {"deep": [{"x": 1}, []]}},
            "geometry": {"type": "Polygon", "coordinates": [[[rnd.random(), i] for _ in range(rnd.randrange(1, 60))]]},
        }
        for i in range(n)
    ]
    whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x}"}}, "features": features, **members}
    return json.dumps(whole, indent=indent, ensure_ascii=seed % 2 == 0), features


def found(spark, path):
    out = []
    for r in readers.read_geojson(spark, str(path)).collect():
        name = dict(r.properties)["Dist_Name"]
        out.append((name, r.geometry.type, json.loads(r.geometry.coordinates)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("indent", [None, 1])
def test_documents_of_many_splits(spark, tmp_path, small_splits, indent):
    want = []
    for i, members in enumerate([{}, {"bbox": [1, 2], "other": {"a": [{"b": 1}]}}, {}]):
        text, features = document(i, 120 if i < 2 else 0, indent, **members)
        (tmp_path / f"{i}.json").write_text(text + "\n" * i)
        want += [(f["properties"]["Dist_Name"], "Polygon", f["geometry"]["coordinates"]) for f in features]
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert found(spark, tmp_path) == sorted(want, key=repr)


def test_documents_equal_the_line_form(spark, tmp_path, small_splits):
    text, features = document(3, 50)
    (tmp_path / "d.json").write_text(text)
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "l.json").write_text("\n".join(json.dumps(f) for f in features))
    both = [
        geometry.vertices(geometry.shapes(df)).orderBy("name", "ring", "seq").collect()
        for df in (readers.read_geojson(spark, str(tmp_path / "d.json")), readers.read_geojson(spark, str(tmp_path / "l"), one_per_line=True))
    ]
    assert both[0] == both[1] and len(both[0]) > 50
