"""Edge cases and properties of the panel analyses."""

import random
from collections import defaultdict

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from panelspark.operators import changes, groups, intensity, marts, panel, rankings, report_cards, trends
from panelspark.plans import pipeline


def random_rows(seed, entities=30, hot=True):
    """A panel with gaps, zeros, repeated cells and an entity that holds a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for e in range(entities):
        for c in "abcdefg":
            for y in range(2010, 2020):
                if rng.random() < 0.6:
                    rows.append((f"e{e:02d}", c, y, rng.choice([0, rng.randint(0, 500)])))
    if hot:
        rows += [("e00", rng.choice("abcdefg"), rng.randint(2010, 2019), rng.randint(0, 9)) for _ in range(len(rows) // 2)]
    return rows


def test_clean_panel(spark, panel_of):
    dirty = spark.createDataFrame(
        [
            (" Agra\t", "2016", "x", "12.9"),
            ("Agra", "2016", "x", "n/a"),
            ("TOTAL district", "2016", "x", "5"),
            ("GRP", "2016", "x", "5"),
            ("G. R. P.", "2016", "x", "5"),
            (None, "2016", "x", "5"),
            ("B", None, "x", "5"),
            ("B", "2017", None, "5"),
            ("B", "2017", "x", None),
        ],
        "entity string, period string, category string, total string",
    )
    out = panel.clean_panel(dirty, panel_of([("C", "x", 2018, 7)]))
    assert {(r.entity, r.period, r.total, r.source) for r in out.collect()} == {
        ("Agra", 2016, 12, None), ("Agra", 2016, 0, None), ("G. R. P.", 2016, 5, None), ("C", 2018, 7, "s"),
    }
    assert dict(out.dtypes)["total"] == "bigint" and dict(out.dtypes)["period"] == "int"


def test_ties_take_the_earliest_period(panel_of):
    df = panel_of([("A", "x", 2001, 5), ("A", "x", 2002, 9), ("A", "x", 2003, 9), ("A", "x", 2004, 5)])
    r = rankings.peak_best(df).first()
    assert (r.peak_period, r.best_period) == (2002, 2001)
    assert trends.category_trend(df).first()["peak_period"] == 2002


def test_category_missing_or_zero(panel_of):
    df = panel_of([("A", "late", 2003, 4), ("A", "zero", 2002, 0), ("A", "full", 2001, 1), ("A", "full", 2003, 2)])
    got = as_dict(trends.category_trend(df), "category")
    assert (got["late"]["first_total"], got["late"]["change_pct"], got["late"]["direction"]) == (0, 0.0, "STABLE")
    assert (got["zero"]["peak_period"], got["zero"]["peak_total"]) == (2001, 0)
    assert got["full"]["change_pct"] == 100.0


def test_how_many_periods_an_entity_needs(panel_of):
    df = panel_of([("one", "x", 2001, 1)] + [("two", "x", y, 1) for y in (2001, 2002)] + [("three", "x", y, 1) for y in (2001, 2002, 2005)])
    assert rankings.entity_ranking(df).count() == 3
    assert {r.entity for r in trends.entity_trend(df).collect()} == {"two", "three"}
    assert {r.entity for r in report_cards.report_cards(df).collect()} == {"three"}


def test_intensity_without_spread_is_null(panel_of):
    scores = intensity.intensity_scores(panel_of([("A", "x", 2001, 5), ("A", "x", 2002, 5), ("B", "x", 2002, 7)]))
    assert {(r.entity, r.period): r.intensity for r in scores.collect()} == {("A", 2001): None, ("A", 2002): 0.0, ("B", 2002): 100.0}


def test_yoy_gaps_zero_bases_and_spikes(panel_of):
    df = panel_of(
        [("A", "x", 2016, 10), ("A", "x", 2018, 15), ("A", "x", 2019, 0), ("A", "x", 2020, 5), ("A", "x", 2021, 5)]
        + [("B", "x", 2016, 0), ("B", "x", 2017, 0), ("B", "x", 2018, 2)]
    )
    yoy = changes.yoy_changes(df)
    got = {(r.entity, r.period): (r.prev_total, r.change, r.change_pct, r.period_gap, r.is_new_from_zero) for r in yoy.collect()}
    assert got["A", 2018] == (10, 5, 50.0, 2, False)
    assert got["A", 2020] == (0, 5, None, 1, True)
    assert got["B", 2017] == (0, 0, None, 1, False)
    assert ("A", 2016) not in got
    assert [(r.entity, r.period) for r in changes.top_spikes(yoy, 4).collect()] == [("A", 2020), ("B", 2018), ("A", 2018), ("A", 2021)]
    assert [(r.entity, r.period) for r in changes.top_drops(yoy).collect()] == [
        ("A", 2019), ("A", 2021), ("A", 2018), ("A", 2020), ("B", 2018), ("B", 2017),
    ]
    cells = panel.cube(df, ["entity", "category", "period"])
    assert sorted(changes.yoy_changes(cells, cells=True).collect()) == sorted(yoy.collect())


def test_regime_mean_is_over_rows(panel_of):
    df = panel_of([("A", "x", 2016, 1), ("A", "y", 2016, 2), ("A", "x", 2017, 9)])
    assert {r.regime: r.mean_total for r in changes.regime_means(df, 2016).collect()} == {"before": 1.5, "after": 9.0}


def test_lookup_is_case_insensitive_and_last_wins(spark, panel_of):
    lookup = groups.lookup_from_dict(spark, {"G1": ["Agra", "b"], "G2": ["B"]})
    out = groups.attach_group(panel_of([("AGRA", "x", 1, 1), ("b", "x", 1, 1), ("c", "x", 1, 1)]), lookup)
    assert {r.entity: r.group for r in out.collect()} == {"AGRA": "G1", "b": "G2", "c": "Other"}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(panel_of, seed):
    rows = random_rows(seed)
    df = panel_of(rows).repartition(7)
    by_entity, by_ec, by_category = defaultdict(int), defaultdict(int), defaultdict(int)
    for e, c, _, t in rows:
        by_entity[e] += t
        by_ec[e, c] += t
        by_category[c] += t
    ranking = as_dict(rankings.entity_ranking(df), "entity")
    assert sorted(r["rank"] for r in ranking.values()) == list(range(1, len(by_entity) + 1))
    assert {e: r["total"] for e, r in ranking.items()} == dict(by_entity)
    order = sorted(by_entity, key=lambda e: (-by_entity[e], e))
    assert [e for e, _ in sorted(ranking.items(), key=lambda x: x[1]["rank"])] == order

    signature = {(r.entity, r["rank"]): (r.category, r.total, r.share_pct) for r in rankings.signature_categories(df).collect()}
    for e in by_entity:
        best = sorted(((c, t) for (x, c), t in by_ec.items() if x == e), key=lambda ct: (-ct[1], ct[0]))[:5]
        for i, (c, t) in enumerate(best, 1):
            assert signature[e, i] == (c, t, round(t / by_entity[e] * 100, 1))

    for r in rankings.concentration(df).collect():
        top = sorted((t for (_, c), t in by_ec.items() if c == r.category), reverse=True)
        assert r.top5_pct == pytest.approx(sum(top[:5]) / sum(top) * 100, abs=0.051)
        assert r.worst_entity_pct <= r.top5_pct <= r.top10_pct <= 100
    kpi = marts.kpis(df).first()
    assert kpi.total == sum(by_entity.values())
    assert (kpi.worst_entity, kpi.worst_entity_total) == (order[0], by_entity[order[0]])
    assert kpi.top_category == min(by_category, key=lambda c: (-by_category[c], c))
    assert kpi.latest_total == sum(t for _, _, y, t in rows if y == 2019) and kpi.latest_period == 2019

    scores = intensity.intensity_scores(df).collect()
    assert all(0 <= r.intensity <= 100 for r in scores)
    assert {r.period for r in scores if r.intensity == 0} == {r.period for r in scores if r.intensity == 100}


def test_results_do_not_depend_on_partitioning(spark, panel_of):
    df = panel_of(random_rows(3))
    lookup = groups.lookup_from_dict(spark, {"G": ["e01", "e02"]})
    one = pipeline.analyses(df.coalesce(1), lookup, (2015, 2016), 2014)
    many = pipeline.analyses(df.repartition(13), lookup, (2015, 2016), 2014, cells=pipeline.panel_cells(df.repartition(5, "period")))
    for name in one:
        a, b = one[name], many[name]
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_marts(spark, panel_of):
    df = panel_of(random_rows(4, entities=20, hot=False))
    cells = {(r.entity, r.category, r.period): r.total for r in panel.cube(df, ["entity", "category", "period"]).collect()}
    top = [r.entity for r in marts.category_top_entities(df, "a", k=3).collect()]
    series = marts.category_top_series(df, "a", k=3).collect()
    assert {r.entity for r in series} == set(top)
    assert all(cells[r.entity, "a", r.period] == r.total for r in series)
    pair = marts.compare_entities(df, ["e01", "e02"], "b").collect()
    assert {(r.entity, r.period): r.total for r in pair} == {
        (e, y): t for (e, c, y), t in cells.items() if e in ("e01", "e02") and c == "b"
    }
    heat = as_dict(marts.heatmap(df, only_entity="e03"), "category")
    assert all(heat[c][str(y)] == t for (e, c, y), t in cells.items() if e == "e03")
    latest = max(y for _, _, y in cells)
    sums = defaultdict(int)
    for (_, c, y), t in cells.items():
        if y == latest:
            sums[c] += t
    assert [(r.category, r.total) for r in marts.latest_top(df, 3).collect()] == sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:3]
    profile = as_dict(marts.entity_profile(df), "entity")
    assert len(profile["e01"]["signature"]) == 5 and profile["e01"]["card"]["grade"]
    assert sum(profile["e01"]["yearly"].values()) == profile["e01"]["total"]
    payload = as_dict(marts.to_json_rows(panel_of([("A", "x", 1, 1)]).withColumn("n", F.lit(None).cast("int"))), "entity")
    assert '"n":null' in payload["A"]["payload"]
    assert marts.find_column(df, "tot") == "total"
    assert marts.label_columns(df, {"entity": "District"}).columns[0] == "District"
    levels = intensity.risk_levels(intensity.intensity_scores(df))
    assert marts.top_intensity(levels, 5).count() == 5
    assert panel.value_counts(df, "category").agg(F.sum("count")).first()[0] == df.count()
