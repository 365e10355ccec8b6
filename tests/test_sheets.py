import pytest
from conftest import as_dict

from panelspark.operators import sheets
from panelspark.schema import RAW_CELLS


def sheet(path, *rows):
    return [(path, i, list(r) if not isinstance(r, str) else [r]) for i, r in enumerate(rows)]


@pytest.fixture
def raw(spark):
    def make(*parts):
        return spark.createDataFrame([r for p in parts for r in p], RAW_CELLS).repartition(4)

    return make


@pytest.mark.parametrize(
    "header",
    [("State: Uttar Pradesh",), ("STATE : uttar pradesh ",), ("State :Uttar Pradesh",), ("Uttar Pradesh",), ("x", " State: Uttar Pradesh")],
)
def test_header_forms(raw, header):
    df = raw(sheet("a/2019/IPC.csv", ("State: Bihar", "", ""), ("1", "Patna", "9"), header, ("1", "Agra", "10"), ("2", "Etah", "4")))
    got = {(r.entity, r.period, r.category, r.total) for r in sheets.extract_sections(df, "Uttar Pradesh").collect()}
    assert got == {("Agra", 2019, "IPC Crimes", 10), ("Etah", 2019, "IPC Crimes", 4)}


def test_fallback_header_only_without_a_strict_one(raw):
    loose = sheet("a/2020_sll.csv", ("1", "Patna", "9"), ("", "", "Districts of Uttar Pradesh (list)"), ("1", "Agra", "3"))
    both = sheet("a/2021_sll.csv", ("", "about Uttar Pradesh", ""), ("1", "Patna", "9"), ("Uttar Pradesh",), ("1", "Agra", "5"))
    got = {(r.entity, r.period, r.total) for r in sheets.extract_sections(raw(loose, both), "Uttar Pradesh").collect()}
    assert got == {("Agra", 2020, 3), ("Agra", 2021, 5)}


def test_row_and_value_rules(raw):
    rows = [
        ("State: Uttar Pradesh",),
        ("7.", "Agra", "1", "12.9"),
        ("8", "Total District(s)", "1", "5"),
        ("9", "GRP", "1", "5"),
        ("", "Etah", "1", "5"),
        ("x1", "Mau", "1", "5"),
        ("10", "Banda", "1", "NA"),
        ("11", "Basti", "1", "-3"),
        ("12", "Ballia", "4"),
        ("13", None, "1", "5"),
        ("14", "Gonda", "1", "Infinity"),
        ("15", "  Mahoba ", "1", "0"),
        ("State: Uttarakhand",),
        ("1", "Almora", "1", "5"),
    ]
    got = {(r.entity, r.total) for r in sheets.extract_sections(raw(sheet("2016/women.csv", *rows)), "Uttar Pradesh").collect()}
    # Ballia's row is shorter than the sheet, so it has no last column.
    assert got == {("Agra", 12), ("Mahoba", 0)}


def test_value_column_by_rule(raw):
    row = ["1", "Agra"] + [str(i) for i in range(2, 25)]
    got = sheets.extract_sections(raw(sheet("2022/Missing.csv", ("Uttar Pradesh",), row)), "Uttar Pradesh").collect()
    assert [(r.total, r.category) for r in got] == [(20, "Missing Persons")]


def test_sections_have_no_limit_of_their_own(raw):
    before = [("State: Bihar", "", "")] + [(str(i), f"b{i}", "1") for i in range(1, 151)]
    rows = before + [("State: Uttar Pradesh", "", "")] + [(str(i), f"d{i:03d}", str(i)) for i in range(1, 701)]
    df = raw(sheet("2018/cyber.csv", *rows))
    assert {r.entity for r in sheets.extract_sections(df, "Uttar Pradesh").collect()} == {f"d{i:03d}" for i in range(1, 701)}
    audit = sheets.load_audit(df, sheets.extract_sections(df, "Uttar Pradesh")).first()
    assert (audit.status, audit.reason, audit.rows, audit.rows_cut) == ("OK", None, 700, 0)


def test_an_explicit_limit_is_reported(raw):
    rows = [("State: Uttar Pradesh", "", "")] + [(str(i), f"d{i:03d}", str(i)) for i in range(1, 201)]
    df = raw(sheet("2018/cyber.csv", *rows), sheet("2018/ipc.csv", *rows[:50]))
    cut = sheets.extract_sections(df, "Uttar Pradesh", max_rows=109)
    bounds = sheets.section_bounds(df, "Uttar Pradesh", max_rows=109)
    audit = as_dict(sheets.load_audit(df, cut, bounds=bounds), "path")
    assert {p: (r["status"], r["rows"], r["rows_cut"]) for p, r in audit.items()} == {
        "2018/cyber.csv": ("CUT", 109, 91),
        "2018/ipc.csv": ("OK", 49, 0),
    }
    assert "91 rows" in audit["2018/cyber.csv"]["reason"]


def test_sections_starting_anywhere(raw, monkeypatch):
    """Every position of a section relative to the blocks of the join."""
    monkeypatch.setattr(sheets, "BLOCK_ROWS", 5)
    parts = []
    for start in range(0, 12):
        rows = [("1", "x", "1")] * start + [("Uttar Pradesh",)] + [(str(i), f"d{i}", "1") for i in range(1, 8)]
        rows += [("State: Goa",), ("1", "Panaji", "1"), ("State: Bihar",)]
        parts.append(sheet(f"2019/ipc_{'a' * (start + 1)}.csv", *rows))
    got = sheets.extract_sections(raw(*parts), "Uttar Pradesh", max_rows=5)
    assert as_dict(got.groupBy("path").count(), "path").keys() == {p[0][0] for p in parts}
    assert {r["count"] for r in got.groupBy("path").count().collect()} == {5}
    full = sheets.extract_sections(raw(*parts), "Uttar Pradesh")
    assert {r["count"] for r in full.groupBy("path").count().collect()} == {7}


def test_file_types(spark):
    names = {
        "Jeveniles_IPC.xlsx": "ipcjuvenile",
        "x_SLL juvenile.xls": "slljuvenile",
        "1_IPC_2019.xlsx": "ipc",
        "SLL.xlsx": "sll",
        "Crime against Woman.xlsx": "women",
        "child_2018.xlsx": "children",
        "AgainstSCs.xlsx": "scs",
        "against STs.xls": "sts",
        "Cyber-2020.xlsx": "cyber",
        "missing.xlsx": "missing",
        "juvenile.xlsx": None,
        "budget.xlsx": None,
    }
    df = spark.createDataFrame([(f"root/2019/{n}",) for n in names], "path string")
    got = {r.file_name: (r.file_type, r.period) for r in sheets.classify_files(df).collect()}
    assert got == {n: (t, 2019) for n, t in names.items()}


def test_first_year_in_path(spark):
    df = spark.createDataFrame([("a/1999/x2021_2016.csv",), ("a/1998/x.csv",), ("a/2030/ipc.csv",)], "path string")
    assert [r[0] for r in df.select(sheets.path_period(df.path)).collect()] == [2021, None, None]


def test_load_audit(spark, raw):
    df = raw(
        sheet("2019/ipc.csv", ("Uttar Pradesh",), ("1", "Agra", "3")),
        sheet("2019/sll.csv", ("Bihar",), ("1", "Patna", "3")),
        sheet("2019/budget.csv", ("Uttar Pradesh",), ("1", "Agra", "3")),
        sheet("old/ipc.csv", ("Uttar Pradesh",), ("1", "Agra", "3")),
    )
    audit = as_dict(sheets.load_audit(df, sheets.extract_sections(df, "Uttar Pradesh")), "path")
    assert {p: (r["status"], r["reason"], r["rows"]) for p, r in audit.items()} == {
        "2019/ipc.csv": ("OK", None, 1),
        "2019/sll.csv": ("FAIL", "no rows in section", 0),
        "2019/budget.csv": ("SKIP", "unknown type", 0),
        "old/ipc.csv": ("SKIP", "no year in name", 0),
    }


def test_one_huge_file_spreads_over_many_keys(spark):
    """No join key of a sheet's rows covers more than a block of them."""
    rows = "'2019/ipc.csv' as path, id as row_idx, if(id = 3, array('Uttar Pradesh'), array(cast(id as string), 'n', '1')) as cells"
    df = spark.range(5000).selectExpr(*rows.split(", ", 2)[:2], rows.split(", ", 2)[2])
    assert sheets.section_rows(df, sheets.section_bounds(df, "Uttar Pradesh")).count() == 4996
    joined = df.selectExpr("path", f"floor(row_idx / {sheets.BLOCK_ROWS}) as b").groupBy("path", "b").count()
    assert joined.agg({"count": "max"}).first()[0] <= sheets.BLOCK_ROWS


def test_headers_anywhere_in_strips_and_parts(raw, monkeypatch):
    """The next header is found at every place of a strip, and over parts that have none."""
    monkeypatch.setattr(sheets, "PART_ROWS", 2 * sheets.STRIP_ROWS)
    wanted, parts = {}, []
    for gap in (1, 2, 61, 62, 63, 64, 65, 127, 128, 129, 400):
        path = f"2019/ipc_{gap}.csv"
        before = [("State: Goa",), ("1", "Panaji", "1")] * (gap % 3)
        rows = [*before, ("Uttar Pradesh",), *[(str(i), "d", "1") for i in range(1, gap)], ("State: Bihar",), ("State: Goa",), ("1", "x", "1")]
        parts.append(sheet(path, *rows))
        wanted[path] = (len(before), len(before) + gap)
    bounds = sheets.section_bounds(raw(*parts), "Uttar Pradesh")
    assert {r.path: (r.start, r.stop) for r in bounds.collect()} == wanted
    # Rows are summed up as numbers, so that tasks of many files do not sort them.
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "collect_list(_head#" not in plan


def test_bounds_that_are_known(spark, raw):
    df = raw(sheet("a/2019/IPC.csv", ("State: Bihar",), ("1", "Patna", "9"), ("Uttar Pradesh",), ("1", "Agra", "10"), ("2", "Etah", "4")))
    bounds = spark.createDataFrame([("a/2019/IPC.csv", 2, 3, 4, 1)], "path string, start long, width int, stop long, rows_cut long")
    assert [r.entity for r in sheets.extract_sections(df, "Uttar Pradesh", bounds=bounds).collect()] == ["Agra"]
