"""Published result values, re-typed: a few entities and categories with all their periods."""

from conftest import as_dict

from panelspark import presets
from panelspark.operators import changes, groups, intensity, rankings, report_cards, trends

YEARS = list(range(2014, 2024))

# Totals per year; 0 stands for "no rows that year".
ENTITY_TOTALS = {
    "Prayagraj": [4760, 7560, 7420, 4752, 28805, 33526, 34270, 30368, 36786, 30362],
    "Aligarh": [6801, 6737, 17843, 4250, 20042, 21126, 19825, 31406, 30477, 29783],
    "Lucknow": [5009, 7585, 33064, 6880, 32968, 38928, 5320, 7615, 5879, 5607],
    "Kanpur Nagar": [5760, 7453, 21909, 5904, 21311, 25471, 29883, 7134, 6513, 6693],
    "Auraiya": [0, 0, 4556, 0, 6302, 6345, 6753, 5644, 6125, 8757],
    "Shamli": [0, 0, 5174, 0, 5973, 6377, 4174, 4163, 4721, 4336],
    "Allahabad": [0, 0, 16211, 0, 0, 0, 0, 0, 0, 0],
}
CATEGORY_TOTALS = {
    "Assault": [13330, 16622, 12665, 19950, 12918, 13865, 13604, 15704, 13532, 16284],
    "Burglary": [15523, 14566, 14840, 14590, 12244, 13056, 16027, 16411, 15750, 16317],
    "Crimes Against STs": [0, 0, 625, 0, 145, 720, 3, 4, 3, 6],
    "Cybercrime": [10997, 14101, 13922, 18157, 12141, 16688, 16149, 14676, 12950, 17470],
    "Kidnapping": [15522, 15604, 14530, 14081, 15747, 13904, 10820, 16059, 13508, 15195],
    "Rape": [16487, 15489, 14642, 14371, 10589, 14547, 17526, 15792, 17154, 15435],
    "Missing Persons": [0, 0, 0, 0, 0, 0, 0, 11010, 12026, 13732],
}
YEAR_TOTALS = [151179, 154467, 717407, 161661, 813450, 872900, 890543, 868236, 1021506, 1063625]


def entities(panel_of):
    return panel_of(
        [(e, "all", y, t) for e, ts in ENTITY_TOTALS.items() for y, t in zip(YEARS, ts) if t > 0]
    )


def categories(panel_of):
    return panel_of([("state", c, y, t) for c, ts in CATEGORY_TOTALS.items() for y, t in zip(YEARS, ts)])


def test_period_trend(panel_of):
    df = panel_of([("state", "all", y, t) for y, t in zip(YEARS, YEAR_TOTALS)])
    got = as_dict(trends.period_trend(df), "period")
    assert [got[y]["change_pct"] for y in YEARS] == [None, 2.17, 364.44, -77.47, 403.18, 7.31, 2.02, -2.5, 17.65, 4.12]
    assert [got[y]["change"] for y in YEARS[:4]] == [None, 3288, 562940, -555746]
    assert trends.overall_change(df).first()["change_pct"] == round((1063625 - 151179) / 151179 * 100, 1)


def test_category_trend(panel_of):
    got = as_dict(trends.category_trend(categories(panel_of)), "category")
    want = {
        "Cybercrime": ("RISING", 58.9, 2017, 18157),
        "Assault": ("RISING", 22.2, 2017, 19950),
        "Burglary": ("STABLE", 5.1, 2021, 16411),
        "Crimes Against STs": ("STABLE", 0.0, 2019, 720),
        "Kidnapping": ("STABLE", -2.1, 2021, 16059),
        "Rape": ("STABLE", -6.4, 2020, 17526),
        "Missing Persons": ("STABLE", 0.0, 2023, 13732),
    }
    for c, (direction, pct, year, peak) in want.items():
        r = got[c]
        assert (r["direction"], r["change_pct"], r["peak_period"], r["peak_total"]) == (direction, pct, year, peak)
        assert (r["first_total"], r["last_total"]) == (CATEGORY_TOTALS[c][0], CATEGORY_TOTALS[c][-1])


def test_two_periods(panel_of):
    compared = changes.compare_periods(categories(panel_of), 2019, 2020)
    got = {c: r["change_pct"] for c, r in as_dict(compared, "category").items()}
    assert got == {
        "Crimes Against STs": -99.6,
        "Kidnapping": -22.2,
        "Cybercrime": -3.2,
        "Assault": -1.9,
        "Rape": 20.5,
        "Burglary": 22.8,
        "Missing Persons": None,
    }
    assert {r["category"] for r in changes.rose(compared).collect()} == {"Rape", "Burglary"}
    assert changes.dropped(compared).count() == 4


def test_entity_trend(panel_of):
    got = as_dict(trends.entity_trend(entities(panel_of)), "entity")
    assert {e: (r["change_pct"], r["rises"], r["falls"], r["trend"]) for e, r in got.items()} == {
        "Prayagraj": (537.9, 5, 4, "RISING"),
        "Aligarh": (337.9, 4, 5, "RISING"),
        "Auraiya": (92.2, 5, 1, "RISING"),
        "Kanpur Nagar": (16.2, 6, 3, "RISING"),
        "Lucknow": (11.9, 5, 4, "STABLE"),
        "Shamli": (-16.2, 3, 3, "FALLING"),
    }
    assert (got["Auraiya"]["first_period"], got["Auraiya"]["last_total"]) == (2016, 8757)
    wide = as_dict(trends.spread_first_last(trends.entity_trend(entities(panel_of)), YEARS), "entity")
    assert wide["Shamli"]["2016_total"] == 5174 and wide["Shamli"]["2014_total"] is None


def test_ranking_and_matrix(panel_of):
    ranking = as_dict(rankings.entity_ranking(entities(panel_of)), "entity")
    assert [(e, r["total"]) for e, r in sorted(ranking.items(), key=lambda x: x[1]["rank"])] == [
        ("Prayagraj", 218609),
        ("Aligarh", 188290),
        ("Lucknow", 148855),
        ("Kanpur Nagar", 138031),
        ("Auraiya", 44482),
        ("Shamli", 34918),
        ("Allahabad", 16211),
    ]
    matrix = as_dict(trends.entity_period_matrix(entities(panel_of)), "entity")
    assert [matrix["Auraiya"][str(y)] for y in YEARS] == ENTITY_TOTALS["Auraiya"]


def test_report_cards(panel_of):
    got = as_dict(report_cards.report_cards(entities(panel_of)), "entity")
    assert {e: (r["trend_pct"], r["grade"], r["first_mean"], r["last_mean"]) for e, r in got.items()} == {
        "Prayagraj": (394.0, "F  (Critical rise)", 6580.0, 32505.0),
        "Aligarh": (192.1, "F  (Critical rise)", 10460.0, 30555.0),
        "Lucknow": (-58.2, "A  (Improving fast)", 15219.0, 6367.0),
        "Kanpur Nagar": (-42.1, "A  (Improving fast)", 11707.0, 6780.0),
        "Auraiya": (19.3, "D  (Worsening)", 5734.0, 6842.0),
        "Shamli": (-24.6, "A  (Improving fast)", 5841.0, 4407.0),
    }
    counts = as_dict(report_cards.grade_distribution(report_cards.report_cards(entities(panel_of))), "grade_letter")
    assert {g: r["entities"] for g, r in counts.items()} == {"A": 3, "B": 0, "C": 0, "D": 1, "F": 2}


def test_peak_and_best(panel_of):
    got = as_dict(rankings.peak_best(entities(panel_of)), "entity")
    assert {e: tuple(r.values())[1:] for e, r in got.items()} == {
        "Lucknow": (2019, 38928, 2014, 5009, 7.77),
        "Prayagraj": (2022, 36786, 2017, 4752, 7.74),
        "Aligarh": (2021, 31406, 2017, 4250, 7.39),
        "Kanpur Nagar": (2020, 29883, 2014, 5760, 5.19),
        "Auraiya": (2023, 8757, 2016, 4556, 1.92),
        "Shamli": (2019, 6377, 2021, 4163, 1.53),
        "Allahabad": (2016, 16211, 2016, 16211, 1.0),
    }


def test_intensity(panel_of):
    # Each year's smallest and largest entity, and two entities in between.
    ends = {2014: (4540, 7505), 2015: (4146, 7971), 2018: (2156, 32968), 2021: (1662, 34219), 2023: (4246, 31034)}
    want = {
        "Aligarh": {2014: 76.3, 2015: 67.7, 2018: 58.0, 2021: 91.4, 2023: 95.3},
        "Prayagraj": {2014: 7.4, 2015: 89.3, 2018: 86.5, 2021: 88.2, 2023: 97.5},
    }
    rows = [(f"{side}", "all", y, t) for y, pair in ends.items() for side, t in zip(("low", "high"), pair)]
    rows += [(e, "all", y, ENTITY_TOTALS[e][YEARS.index(y)]) for e in want for y in ends]
    scores = intensity.intensity_scores(panel_of(rows))
    got = {(r.entity, r.period): r.intensity for r in scores.collect()}
    for e, by_year in want.items():
        for y, score in by_year.items():
            assert got[e, y] == score
            assert (got["low", y], got["high", y]) == (0.0, 100.0)
    levels = {r.entity: r.risk_level for r in intensity.risk_levels(scores).collect()}
    assert levels == {"low": None, "high": "CRITICAL", "Aligarh": "CRITICAL", "Prayagraj": "HIGH"}


def test_divisions(spark, panel_of):
    lookup = groups.lookup_from_dict(spark, presets.DIVISIONS)
    assert lookup.count() == 73
    got = {(r.group, r.period): r.total for r in groups.group_rollup(entities(panel_of), lookup).collect()}
    assert got["Kanpur", 2018] == 6302 + 21311
    assert got["Other", 2016] == 16211
    totals = {r.group: r.total for r in groups.group_totals(entities(panel_of), lookup).collect()}
    assert totals["Meerut"] == 34918 and totals["Lucknow"] == 148855
