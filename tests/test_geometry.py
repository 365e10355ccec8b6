import random

import pytest

from panelspark import presets
from panelspark.operators import geometry, marts


@pytest.fixture
def shape_rows(spark):
    rng = random.Random(5)
    rows = []
    for i in range(12):
        rings = [[(rng.uniform(77, 84), rng.uniform(24, 30)) for _ in range(rng.randint(3, 9))] for _ in range(1 + i % 3)]
        rows.append((f"s{i:02d}", f"E{i}", rings))
    df = spark.createDataFrame(rows, "name string, entity string, rings array<array<struct<x:double,y:double>>>")
    return rows, df


def test_projection_paths_and_centroids(shape_rows):
    rows, df = shape_rows
    xs = [p[0] for _, _, rings in rows for r in rings for p in r]
    ys = [p[1] for _, _, rings in rows for r in rings for p in r]
    lo_x, hi_x, lo_y, hi_y = min(xs), max(xs), min(ys), max(ys)
    assert tuple(geometry.bbox(df).first()) == (lo_x, hi_x, lo_y, hi_y)
    w, h = 820.0, 540.0
    k = min(w / (hi_x - lo_x), h / (hi_y - lo_y))

    def place(p):
        return (
            round(20 + (p[0] - lo_x) * k + (w - (hi_x - lo_x) * k) / 2, 2),
            round(20 + (hi_y - p[1]) * k + (h - (hi_y - lo_y) * k) / 2, 2),
        )

    projected = geometry.project(df)
    got = {r.name: r for r in geometry.centroids(geometry.feature_paths(projected)).collect()}
    for name, _, rings in rows:
        placed = [[place(p) for p in r] for r in rings]
        flat = [p for r in placed for p in r]
        assert got[name].path == " ".join("M" + " L".join(f"{x},{y}" for x, y in r) + "Z" for r in placed)
        assert got[name].center_x == pytest.approx(sum(p[0] for p in flat) / len(flat))
        assert got[name].center_y == pytest.approx(sum(p[1] for p in flat) / len(flat))
        assert all(20 <= x <= 840 and 20 <= y <= 560 for x, y in flat)
    assert geometry.vertices(df).count() == len(xs)
    plan = projected.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan


def test_colors_go_round_in_name_order(shape_rows):
    rows, df = shape_rows
    got = {r.name: r.color for r in geometry.assign_colors(df.union(df)).collect()}
    assert got == {n: presets.MAP_PALETTE[i % 9] for i, n in enumerate(sorted(r[0] for r in rows))}


def test_choropleth_defaults(shape_rows, panel_of):
    _, df = shape_rows
    panel = panel_of([("E1", "x", 2001, 5), ("E1", "x", 2002, 6), ("E2", "y", 2001, 7)])
    got = {r.entity: (r.total, r.matched) for r in marts.choropleth(panel, "x", df).collect()}
    assert got["E1"] == (11, True) and got["E2"] == (0, False) and len(got) == 12
