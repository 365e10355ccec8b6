"""Forecast of the next period from lag features, with pyspark.ml models."""

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import clamp_count, pct_change_guarded, round_scaled
from panelspark.operators.ordered import ordered_index
from panelspark.operators.panel import cube

# Bytes of training rows, as stored, that are worth a core of their own, and that one partition holds at most, about.
CORE_BYTES = 1 << 20
FIT_BYTES = 32 << 20
FEATURES = ("entity_code", "category_code", "period_norm", "lag1", "lag2", "roll_mean")

# Settings the published figures were made with.
DEFAULT_PARAMS = {
    "gradient_boosting": {"maxIter": 200, "stepSize": 0.05, "maxDepth": 5, "maxBins": 256, "seed": 42},
    "random_forest": {
        "numTrees": 200,
        "maxDepth": 10,
        "maxBins": 256,
        "featureSubsetStrategy": "all",
        "seed": 42,
    },
    "linear_regression": {"regParam": 0.0, "solver": "normal"},
}
_LEARNERS = {
    "gradient_boosting": GBTRegressor,
    "random_forest": RandomForestRegressor,
    "linear_regression": LinearRegression,
}


def encode_sorted(df: DataFrame, column: str, name: str, values: DataFrame | None = None) -> DataFrame:
    """Add the 0-based position of each value among the sorted distinct values (of ``values``, if given).

    A join with the numbered distinct values; the values never go to the driver,
    as they would with an indexer model. Codes are plain numbers without
    category metadata: the learners treat them as such. No join hint: whether the
    codes are broadcast is left to their measured size at run time.
    """
    distinct = (df if values is None else values).select(column).distinct()
    codes = ordered_index(distinct, asc=[column], name="_code")
    return df.join(codes, column).withColumn(name, (F.col("_code") - 1).cast("double")).drop("_code")


def lag_features(
    df: DataFrame,
    lags: Sequence[int] = (1, 2),
    roll: int = 3,
    cells: bool = False,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Codes, period offset, lagged totals and trailing mean of every entity/category.

    The first period of each pair has no lag and is left out; further lags that
    are missing take the value of the first. Codes and offsets count the whole
    panel, including what is left out. The grain is read several times (series,
    first period, codes): pass materialised cells with ``cells=True`` unless the
    panel is cheap to read.
    """
    grain = df if cells else cube(df, [entity, category, period], total)
    grain = grain.select(
        F.col(entity).alias("entity"),
        F.col(category).alias("category"),
        F.col(period).alias("period"),
        F.col(total).alias("total"),
    )
    first_period = grain.agg(F.min("period")).scalar()
    w = Window.partitionBy("entity", "category").orderBy("period")
    trailing = w.rowsBetween(-roll, -1)
    lagged = (
        grain.withColumn("_first", first_period)
        .withColumns(
            {
                "period_norm": (F.col("period") - F.col("_first")).cast("double"),
                **{f"lag{k}": F.lag("total", k).over(w).cast("double") for k in lags},
                "roll_mean": F.sum("total").over(trailing) / F.count("total").over(trailing),
            }
        )
        .filter(F.col("lag1").isNotNull())
        .withColumns(
            {
                **{f"lag{k}": F.coalesce(f"lag{k}", "lag1") for k in lags if k != 1},
                "roll_mean": F.coalesce("roll_mean", "lag1"),
            }
        )
        .drop("_first")
    )
    # Codes are looked up in a table of the pairs, on the keys that the window has dealt the rows by.
    pairs = encode_sorted(grain.select("entity", "category").distinct(), "entity", "entity_code", values=grain)
    axis = grain.agg(F.array_sort(F.collect_set("category"))).scalar()
    position = F.array_position("_axis", F.col("category")) - 1
    coded = pairs.withColumn("_axis", axis).withColumn("category_code", position.cast("double")).drop("_axis")
    return lagged.join(coded, ["entity", "category"]).select(
        "category", "entity", "period", "total", "period_norm", *[f"lag{k}" for k in lags], "roll_mean", "entity_code", "category_code"
    )


def temporal_split(features: DataFrame, holdout: int = 2) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last ``holdout`` periods are the test."""
    last = features.agg(F.max("period")).scalar()
    marked = features.withColumn("_last", last)
    is_train = F.col("period") <= F.col("_last") - holdout
    return marked.filter(is_train).drop("_last"), marked.filter(~is_train).drop("_last")


def fit_models(
    train: DataFrame,
    params: Mapping[str, Mapping] | None = None,
    features: Sequence[str] = FEATURES,
    label: str = "total",
) -> dict[str, PipelineModel]:
    """Fit the three regressors; ``params`` selects some of them or changes their settings.

    The features are assembled once and kept while all learners read them. A small panel is a single partition: a
    boosted model is hundreds of jobs, of which each task would cost more than its rows. A larger one is dealt to all cores,
    but to no more partitions: of each a forest's statistics are shuffled, whose size does not depend on its rows.
    What an executor loses is read from the training rows again.
    """
    chosen = DEFAULT_PARAMS if params is None else params
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    size = int(str(train._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = train.sparkSession.sparkContext.defaultParallelism
    many, parts = -(-size // FIT_BYTES), min(-(-size // CORE_BYTES), cores)
    rows = train.select(*features, label)
    if 1 < parts and many <= cores:
        rows = rows.repartition(parts)  # files of few row groups would leave most tasks without rows
    else:  # never more than there are: the size of a plan that is not stored may be estimated without bounds
        rows = rows.coalesce(min(max(1, many), 1 << 30))
    dealt = assembler.transform(rows).select("features", label)
    dealt.persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    try:
        for name, changes in chosen.items():
            learner = _LEARNERS[name](featuresCol="features", labelCol=label, **{**DEFAULT_PARAMS[name], **changes})
            out[name] = PipelineModel(stages=[assembler, learner.fit(dealt)])
    finally:
        dealt.unpersist()
    return out


def non_negative(prediction: str = "prediction") -> Column:
    return F.greatest(F.lit(0.0), F.col(prediction))


def _metric_columns(label: str, prediction: Column) -> list[Column]:
    err = F.col(label) - prediction
    squares = F.sum(err * err)
    n = F.count(F.lit(1))
    return [
        n.alias("rows"),
        round_scaled(F.avg(F.abs(err)), 2).alias("mae"),
        round_scaled(F.sqrt(F.avg(err * err)), 2).alias("rmse"),
        round_scaled(F.lit(1.0) - F.try_divide(squares, F.var_pop(label) * n), 4).alias("r2"),
    ]


def regression_metrics(pred: DataFrame, label: str = "total", prediction: str = "prediction") -> DataFrame:
    """One row: rows, MAE, RMSE, R2 of the predictions, in one aggregate."""
    return pred.agg(*_metric_columns(label, F.col(prediction)))


def evaluate(models: Mapping[str, PipelineModel], test: DataFrame, label: str = "total") -> DataFrame:
    """Metrics of every model on the test rows, predictions cut off at zero. One row per model.

    All models score in the same pass: the features are assembled once and each
    model adds its own prediction column. ``rmse_exact`` is not rounded.
    """
    scored = next(iter(models.values())).stages[0].transform(test)
    rows = []
    for name, model in models.items():
        fitted = model.stages[-1]
        scored = fitted.copy({fitted.predictionCol: f"_{name}"}).transform(scored)
        prediction = non_negative(f"_{name}")
        err = F.col(label) - prediction
        rows.append(
            F.struct(
                F.lit(name).alias("model"),
                *_metric_columns(label, prediction),
                F.sqrt(F.avg(err * err)).alias("rmse_exact"),
            )
        )
    return scored.agg(F.array(*rows).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def select_best(models: Mapping[str, PipelineModel], metrics: DataFrame) -> tuple[str, PipelineModel]:
    """Name and model of the smallest RMSE (one metrics row per model reaches the driver)."""
    best = metrics.orderBy("rmse_exact", "model").first()["model"]
    return best, models[best]


def feature_importance(model: PipelineModel, like: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, importance) of a tree model, by falling importance."""
    spark = like.sparkSession
    weights = getattr(model.stages[-1], "featureImportances", None)
    rows = [] if weights is None else [(f, float(w)) for f, w in zip(features, weights.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def next_period_features(features: DataFrame, roll: int = 3) -> DataFrame:
    """One row per pair that has the latest period: its features for the period after.

    lag1 is the latest total; lag2 the one a period earlier, else lag1; the
    trailing mean takes the pair's last rows. The period offset counts from the
    first period *of the feature rows*, as published. Grouping reuses the
    window's partitioning, and pairs never multiply out.
    """
    ends = features.agg(F.struct(F.min("period").alias("lo"), F.max("period").alias("hi"))).scalar()
    latest_first = Window.partitionBy("entity", "category").orderBy(F.col("period").desc())
    recent = features.withColumn("_ends", ends).withColumn("_i", F.row_number().over(latest_first))
    hi = F.col("_ends.hi")
    return (
        recent.groupBy("entity", "category")
        .agg(
            F.max("entity_code").alias("entity_code"),
            F.max("category_code").alias("category_code"),
            F.max(hi - F.col("_ends.lo") + 1).cast("double").alias("period_norm"),
            F.max(hi + 1).alias("period"),
            F.max(F.when(F.col("period") == hi, F.col("total"))).cast("double").alias("lag1"),
            F.max(F.when(F.col("period") == hi - 1, F.col("total"))).cast("double").alias("lag2"),
            (
                F.sum(F.when(F.col("_i") <= roll, F.col("total")))
                / F.sum(F.when(F.col("_i") <= roll, F.lit(1)))
            ).alias("roll_mean"),
        )
        .filter(F.col("lag1").isNotNull())
        .withColumn("lag2", F.coalesce("lag2", "lag1"))
    )


def score_next(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Whole, non-negative prediction with change against the latest total."""
    out = scored.select(
        "entity",
        "category",
        "period",
        F.col("lag1").cast("bigint").alias("actual"),
        clamp_count(F.col(prediction)).alias("predicted"),
    )
    return out.withColumns(
        {
            "change": F.col("predicted") - F.col("actual"),
            "change_pct": pct_change_guarded(F.col("actual"), F.col("predicted")),
        }
    )


def forecast(model: PipelineModel, next_features: DataFrame) -> DataFrame:
    return score_next(model.transform(next_features))


def model_card(best: str, metrics: DataFrame, features: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row with the model record: best model and its metrics, data ranges, all models."""
    n = F.struct("rows", "mae", "rmse", "r2")
    all_models = metrics.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", n)))).alias("all_models")
    )
    chosen = F.try_element_at("all_models", F.lit(best))
    # collect_set of categories and periods: both are axes of the model card.
    return features.agg(
        F.countDistinct("entity").alias("entities"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("period")).alias("periods_trained"),
        (F.max("period") + 1).alias("prediction_period"),
    ).withColumns(
        {
            "best_model": F.lit(best),
            "train_rows": train.agg(F.count(F.lit(1))).scalar(),
            "test_rows": test.agg(F.count(F.lit(1))).scalar(),
            "all_models": all_models.scalar(),
        }
    ).withColumns({"rmse": chosen["rmse"], "r2": chosen["r2"], "mae": chosen["mae"]})
