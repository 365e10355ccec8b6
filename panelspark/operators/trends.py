"""Trends over periods: whole panel, per category, per entity."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark import presets
from panelspark.functions.labels import direction
from panelspark.functions.numeric import pct_change_guarded, pct_change_null, round_exact
from panelspark.operators.panel import cube, panel_ends, wide_matrix


def period_trend(
    df: DataFrame, period: str = "period", total: str = "total", by: Sequence[str] = ()
) -> DataFrame:
    """Total per period with difference and percent change to the period before.

    ``by`` (for example ``("source",)``) keeps separate series apart. The window
    runs over one row per period.
    """
    w = Window.partitionBy(*by).orderBy(period)
    before = F.lag(total).over(w)
    return cube(df, [*by, period], total).select(
        *by,
        period,
        total,
        (F.col(total) - before).alias("change"),
        pct_change_null(before, F.col(total), 2).alias("change_pct"),
    )


def overall_change(df: DataFrame, period: str = "period", total: str = "total") -> DataFrame:
    """One row: first and last period, their totals, percent change."""
    yearly = cube(df, [period], total)
    return yearly.agg(
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        F.min_by(total, period).alias("first_total"),
        F.max_by(total, period).alias("last_total"),
    ).withColumn(
        "change_pct",
        round_exact(F.try_divide(F.col("last_total") - F.col("first_total"), F.col("first_total")) * 100.0, 1),
    )


def category_trend(
    df: DataFrame,
    band: float = presets.CATEGORY_BAND,
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Per category: totals of the panel's first and last period, change, class, peak.

    Periods a category lacks count as 0, so its first and last values are those
    of the panel's range, and a category that is 0 throughout peaks in the
    panel's first period. Of equal peaks the earliest counts.
    """
    cells = cube(df, [category, period], total)
    first, last = panel_ends(cells, period, total)
    zero = F.lit(0).cast("bigint")
    return (
        cells.withColumns({"_first": first, "_last": last})
        .groupBy(category)
        .agg(
            F.coalesce(F.sum(F.when(F.col(period) == F.col("_first"), F.col(total))), zero).alias("first_total"),
            F.coalesce(F.sum(F.when(F.col(period) == F.col("_last"), F.col(total))), zero).alias("last_total"),
            F.max(F.struct(F.col(total).alias("v"), (-F.col(period)).alias("p"))).alias("_peak"),
            F.min("_first").alias("_first"),
        )
        .withColumn("change_pct", pct_change_guarded(F.col("first_total"), F.col("last_total")))
        .select(
            category,
            direction(F.col("change_pct"), band).alias("direction"),
            "first_total",
            "last_total",
            "change_pct",
            F.when(F.col("_peak.v") > 0, -F.col("_peak.p")).otherwise(F.col("_first")).alias("peak_period"),
            F.greatest(F.col("_peak.v"), zero).alias("peak_total"),
        )
    )


def period_category_matrix(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    return wide_matrix(df, [period], category, categories, total)


def entity_period_matrix(
    df: DataFrame,
    periods: Sequence[int] | None = None,
    entity: str = "entity",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    return wide_matrix(df, [entity], period, periods, total)


def entity_trend(
    df: DataFrame,
    band: float = presets.ENTITY_BAND,
    min_periods: int = 2,
    entity: str = "entity",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Per entity: its own first and last total, change, rises, falls, class.

    After the sums an entity has one row per period, so the window's groups are
    small however many rows the entity has. The second grouping reuses the
    window's partitioning.
    """
    w = Window.partitionBy(entity).orderBy(period)
    steps = cube(df, [entity, period], total).withColumn("_step", F.col(total) - F.lag(total).over(w))
    return (
        steps.groupBy(entity)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(period).alias("first_period"),
            F.min_by(total, period).alias("first_total"),
            F.max(period).alias("last_period"),
            F.max_by(total, period).alias("last_total"),
            F.count_if(F.col("_step") > 0).alias("rises"),
            F.count_if(F.col("_step") < 0).alias("falls"),
        )
        .filter(F.col("_n") >= min_periods)
        .drop("_n")
        .withColumn("change_pct", pct_change_guarded(F.col("first_total"), F.col("last_total")))
        .withColumn("trend", direction(F.col("change_pct"), band))
    )


def spread_first_last(trend: DataFrame, periods: Sequence[int], entity: str = "entity") -> DataFrame:
    """Wide form of :func:`entity_trend`: ``<period>_total`` holds the first or last total, else NULL."""
    cells = [
        F.when(F.col("last_period") == p, F.col("last_total"))
        .when(F.col("first_period") == p, F.col("first_total"))
        .alias(f"{p}_total")
        for p in periods
    ]
    return trend.select(entity, "change_pct", "rises", "falls", "trend", *cells)


def middle_value(
    df: DataFrame, category: str = "category", period: str = "period", total: str = "total"
) -> DataFrame:
    """Per category: the value at position ``n // 2`` of its series by period."""
    w = Window.partitionBy(category).orderBy(period)
    everything = Window.partitionBy(category)
    return (
        cube(df, [category, period], total)
        .withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(everything)})
        .filter(F.col("_i") == F.floor(F.col("_n") / 2))
        .select(category, F.col(period).alias("middle_period"), F.col(total).alias("middle_total"))
    )
