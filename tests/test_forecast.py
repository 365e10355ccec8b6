import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import forecast, marts
from panelspark.plans import pipeline
from panelspark.sources import sinks


def make_rows(seed=11):
    rng = random.Random(seed)
    rows = []
    for e in range(25):
        for c in "abcd":
            base = rng.randint(20, 400)
            for y in range(2012, 2021):
                if rng.random() < 0.9:
                    rows.append((f"e{e:02d}", c, y, max(0, base + rng.randint(-30, 30))))
    rows.append(("zz", "a", 2020, 5))  # a single row: numbered, but without lags
    rows += [("yy", "b", 2019, 5), ("yy", "b", 2020, 9)]
    return rows


def brute_features(rows):
    entities = sorted({r[0] for r in rows})
    categories = sorted({r[1] for r in rows})
    first = min(r[2] for r in rows)
    series = defaultdict(list)
    for e, c, y, t in sorted(rows):
        series[e, c].append((y, t))
    out = {}
    for (e, c), points in series.items():
        for i in range(1, len(points)):
            y, t = points[i]
            past = [p[1] for p in points[:i]]
            out[e, c, y] = (
                t,
                float(entities.index(e)),
                float(categories.index(c)),
                float(y - first),
                float(past[-1]),
                float(past[-2] if len(past) > 1 else past[-1]),
                sum(past[-3:]) / len(past[-3:]),
            )
    return out


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture
def features(panel_of, rows):
    return forecast.lag_features(panel_of(rows).repartition(6)).cache()


def test_features(features, rows):
    got = {
        (r.entity, r.category, r.period): (r.total, r.entity_code, r.category_code, r.period_norm, r.lag1, r.lag2, r.roll_mean)
        for r in features.collect()
    }
    assert got == brute_features(rows)


def test_split(features):
    train, test = forecast.temporal_split(features)
    assert {r.period for r in test.select("period").distinct().collect()} == {2019, 2020}
    assert train.agg({"period": "max"}).first()[0] == 2018
    assert train.count() + test.count() == features.count()


def test_next_period(features, rows):
    want = {}
    history = defaultdict(dict)
    for (e, c, y), f in brute_features(rows).items():
        history[e, c][y] = f
    for (e, c), h in history.items():
        if 2020 in h:
            last = [h[y][0] for y in sorted(h)[-3:]]
            lag1 = float(h[2020][0])
            want[e, c] = (lag1, float(h[2019][0]) if 2019 in h else lag1, sum(last) / len(last), float(2021 - 2013))
    got = {(r.entity, r.category): (r.lag1, r.lag2, r.roll_mean, r.period_norm) for r in forecast.next_period_features(features).collect()}
    assert got == want
    assert ("yy", "b") in got and ("zz", "a") not in got


def test_least_squares_equals_numpy(features):
    train, test = forecast.temporal_split(features)
    models = forecast.fit_models(train, {"linear_regression": {}})
    t = train.toPandas()
    x = np.column_stack([t[list(forecast.FEATURES)].to_numpy(), np.ones(len(t))])
    coef, *_ = np.linalg.lstsq(x, t["total"].to_numpy(float), rcond=None)
    v = test.toPandas()
    pred = np.maximum(np.column_stack([v[list(forecast.FEATURES)].to_numpy(), np.ones(len(v))]) @ coef, 0)
    err = v["total"].to_numpy(float) - pred
    m = forecast.evaluate(models, test).first()
    assert m.rows == len(v)
    assert m.mae == pytest.approx(np.abs(err).mean(), abs=0.006)
    assert m.rmse == pytest.approx(np.sqrt((err**2).mean()), abs=0.006)
    total = v["total"].to_numpy(float)
    assert m.r2 == pytest.approx(1 - (err**2).sum() / ((total - total.mean()) ** 2).sum(), abs=0.0001)


def test_pipeline(spark, panel_of, rows, tmp_path):
    small = {"gradient_boosting": {"maxIter": 5}, "random_forest": {"numTrees": 10}, "linear_regression": {}}
    out = pipeline.run_forecast(panel_of(rows), small)
    metrics = {r.model: r for r in out["metrics"].collect()}
    assert set(metrics) == set(small) and all(0.5 < m.r2 <= 1 for m in metrics.values())
    card = out["model_card"].first()
    assert card.best_model == min(metrics, key=lambda m: metrics[m].rmse)
    assert card.rmse == metrics[card.best_model].rmse and set(card.all_models) == set(small)
    assert (card.prediction_period, card.entities, card.categories) == (2021, 26, list("abcd"))
    assert card.periods_trained == list(range(2013, 2021))
    assert card.train_rows + card.test_rows == len(brute_features(rows))
    pred = out["predictions"].collect()
    assert all(r.predicted >= 0 and r.change == r.predicted - r.actual and r.period == 2021 for r in pred)
    by_entity = defaultdict(int)
    for r in pred:
        by_entity[r.entity] += r.predicted
    want = sorted(by_entity.items(), key=lambda x: (-x[1], x[0]))
    assert [(r.entity, r.predicted) for r in out["by_entity"].collect()] == want[:20]
    assert len(out["compare"].collect()) == 15
    assert {r.category for r in out["by_category"].collect()} == set("abcd")
    pipeline.write_forecast(out, str(tmp_path))
    doc = json.loads(next((tmp_path / "model_card").glob("part-*.json")).read_text())
    assert doc["best_model"] == card.best_model and doc["all_models"]["random_forest"]["rows"] == card.test_rows


def test_importance_and_empty_for_linear(spark, features):
    train, _ = forecast.temporal_split(features)
    models = forecast.fit_models(train, {"random_forest": {"numTrees": 5}, "linear_regression": {}})
    ranked = forecast.feature_importance(models["random_forest"], features).collect()
    assert {r.feature for r in ranked} == set(forecast.FEATURES)
    assert sum(r.importance for r in ranked) == pytest.approx(1)
    assert [r.importance for r in ranked] == sorted((r.importance for r in ranked), reverse=True)
    assert forecast.feature_importance(models["linear_regression"], features).count() == 0


def test_trees_take_more_codes_than_default_bins(panel_of):
    rows = [(f"e{e:03d}", "a", y, e + y % 3) for e in range(90) for y in range(2015, 2020)]
    train, _ = forecast.temporal_split(forecast.lag_features(panel_of(rows)))
    assert forecast.fit_models(train, {"random_forest": {"numTrees": 2}})["random_forest"]


def test_scores_are_clamped(spark):
    df = spark.createDataFrame(
        [("a", "x", 2021, 10.0, -4.2), ("b", "x", 2021, 0.0, 2.5), ("c", "x", 2021, 8.0, 9.5)],
        "entity string, category string, period int, lag1 double, prediction double",
    )
    got = {r.entity: (r.actual, r.predicted, r.change, r.change_pct) for r in forecast.score_next(df).collect()}
    assert got == {"a": (10, 0, -10, -100.0), "b": (0, 2, 2, 0.0), "c": (8, 10, 2, 25.0)}
    assert marts.forecast_by_category(forecast.score_next(df)).first().avg_change == -25.0


def test_fits_use_the_cores_that_a_panel_fills(spark, monkeypatch):
    """A panel of many rows in few bytes is no single task; a small one is."""

    class Learner:
        def __init__(self, **settings):
            pass

        def fit(self, df):
            seen.append(df.rdd.glom().map(len).collect())

    monkeypatch.setattr(forecast, "_LEARNERS", {"linear_regression": Learner})
    seen = []
    for n in (1000, 400_000):
        rows = spark.range(0, n, 1, 1).select(*[F.col("id").cast("double").alias(f) for f in forecast.FEATURES], F.col("id").alias("total"))
        forecast.fit_models(rows, {"linear_regression": {}})
    assert len(seen[0]) == 1 and len(seen[1]) == spark.sparkContext.defaultParallelism
    assert sum(seen[1]) == 400_000 and max(seen[1]) < 2 * min(seen[1])
