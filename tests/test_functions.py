import math
import random

import numpy as np
from conftest import as_dict
from pyspark.sql import functions as F

from panelspark.functions import labels as L
from panelspark.functions import numeric as N


def doubles():
    rng = random.Random(7)
    out = [0.05, 0.15, 0.25, 0.35, 0.45, 2.675, 1.005, 12.25, -0.15, -0.25, 0.0, 1e-9, 123456.65, -99.95, 100.0]
    out += [n / d * 100 for d in (8, 16, 80, 400, 2000, 7) for n in range(1, 60)]
    out += [rng.uniform(-1000, 1000) for _ in range(500)]
    out += [round(rng.uniform(-50, 50), 3) for _ in range(2000)]
    return out


def test_roundings_equal_python_and_numpy(spark):
    xs = doubles()
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    cols = {f"e{d}": N.round_exact(F.col("x"), d) for d in (1, 2)}
    cols |= {f"s{d}": N.round_scaled(F.col("x"), d) for d in (0, 1, 2)}
    for r in df.withColumns(cols).collect():
        for d in (1, 2):
            assert r[f"e{d}"] == round(r.x, d), (r.x, d)
        for d in (0, 1, 2):
            assert r[f"s{d}"] == np.round(np.float64(r.x), d), (r.x, d)


def test_percentages(spark):
    df = spark.createDataFrame([(0, 5), (0, 0), (8, 10), (400, 401), (None, 3)], "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    rows = df.select(N.pct_change_guarded(a, b), N.pct_change_null(a, b), N.share_pct(a, b)).collect()
    assert [tuple(r) for r in rows] == [(0.0, None, 0.0), (0.0, None, 0.0), (25.0, 25.0, 80.0), (0.2, 0.2, 99.8), (0.0, None, None)]


def test_lenient_numbers(spark):
    texts = ["12", " 12.9\t", "-3.7", "1e3", ".5", "5.", "", "NA", "1,234", "12d", "NaN", "Infinity", "0x10", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(N.to_count(F.col("t"))).collect()]
    assert got == [12, 12, -3, 1000, 0, 5] + [None] * 8


def test_clamp_and_strip(spark):
    df = spark.createDataFrame([(-0.6, " a\n"), (2.5, "b"), (3.5, "\tc ")], "x double, s string")
    rows = df.select(N.clamp_count(F.col("x")), N.strip(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(0, "a"), (2, "b"), (4, "c")]


def test_bins_grades_and_directions(spark):
    xs = [0.0, 0.1, 25.0, 25.1, 50.0, 75.1, 100.0, 100.1, -1.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(L.right_closed_bin(F.col("x"))).collect()]
    assert got == [None, "LOW", "LOW", "MEDIUM", "MEDIUM", "CRITICAL", "CRITICAL", None, None]
    cuts = spark.createDataFrame([(x,) for x in (-20.1, -20.0, -5.0, 5.0, 20.0)], "x double")
    assert [r[0][0] for r in cuts.select(L.grade(F.col("x"))).collect()] == ["A", "B", "C", "D", "F"]
    flags = spark.createDataFrame([(x,) for x in (10.0, 10.1, -10.0, -10.1)], "x double")
    assert [r[0] for r in flags.select(L.direction(F.col("x"), 10)).collect()] == ["STABLE", "RISING", "STABLE", "FALLING"]


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("F  (Critical rise)", "Lakhimpur Kheri", 3.0), ("C", "Agra", -1.0), ("B  (x)", "Kheri", 0.0)],
        "g string, n string, v double",
    )
    out = as_dict(
        df.select(
            "g",
            L.label_letter(F.col("g")).alias("l"),
            L.label_text(F.col("g")).alias("t"),
            L.shorten(F.col("n")).alias("s"),
            L.arrow(F.col("v")).alias("a"),
            L.bar(F.col("v"), F.lit(3.0), 4, at_least=1).alias("b"),
            L.map_value(F.col("n"), {"Kheri": "Khiri"}, keep_unmatched=True).alias("m"),
            L.map_value(F.col("n"), {"Kheri": "Khiri"}).alias("u"),
            L.first_filled(F.nullif("n", F.lit("Agra")), F.lit(""), default="Unknown").alias("f"),
            L.matches_any_prefix(F.col("g"), ["F", "B"]).alias("p"),
        ),
        "g",
    )
    assert out["F  (Critical rise)"] == dict(
        g="F  (Critical rise)", l="F", t="Critical rise", s="Lakhimp..", a="▲", b="████", m="Lakhimpur Kheri", u=None,
        f="Lakhimpur Kheri", p=True,
    )
    assert out["C"] == dict(g="C", l="C", t="", s="Agra", a="▼", b="█", m="Agra", u=None, f="Unknown", p=False)
    assert out["B  (x)"]["m"] == "Khiri" and out["B  (x)"]["a"] == "→" and out["B  (x)"]["t"] == "x"


def test_aggregate_names(spark):
    names = ["Total District(s)", "GRP", "G. R. P.", "Grand x", "Agra", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(L.is_aggregate_name(F.col("n"))).collect()] == [True, True, False, True, False, False]
    assert math.isfinite(1.0)
