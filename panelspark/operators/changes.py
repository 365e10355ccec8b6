"""Changes between periods: year on year, two fixed periods, two regimes."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import pct_change_null
from panelspark.operators.panel import cube


def yoy_changes(
    df: DataFrame,
    cells: bool = False,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Change of every entity/category from its previous period; the first has none and is left out.

    The previous period is the previous one present: gaps are bridged, and
    ``period_gap`` tells how far. A percentage on a zero base is NULL;
    ``is_new_from_zero`` marks the rises from zero among these.

    A panel has one row per (entity, category, period). Repeated rows are summed
    first, which also keeps the window's groups as small as the number of periods.
    Pass ``cells=True`` when the input is known to have no repeats; that saves
    the shuffle of the sum.
    """
    grain = df if cells else cube(df, [entity, category, period], total)
    w = Window.partitionBy(entity, category).orderBy(period)
    return (
        grain.select(
            entity,
            category,
            period,
            total,
            F.lag(total).over(w).alias("prev_total"),
            (F.col(period) - F.lag(period).over(w)).alias("period_gap"),
        )
        .filter(F.col("prev_total").isNotNull())
        .withColumns(
            {
                "change": F.col(total) - F.col("prev_total"),
                "change_pct": pct_change_null(F.col("prev_total"), F.col(total)),
                "is_new_from_zero": (F.col("prev_total") == 0) & (F.col(total) > 0),
            }
        )
    )


def top_spikes(
    yoy: DataFrame,
    k: int = 10,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
) -> DataFrame:
    """The ``k`` largest rises in percent; rises from zero are infinite and come first."""
    return yoy.orderBy(
        F.col("is_new_from_zero").desc(), F.col("change_pct").desc_nulls_last(), entity, category, period
    ).limit(k)


def top_drops(
    yoy: DataFrame,
    k: int = 10,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
) -> DataFrame:
    """The ``k`` largest falls in percent; rises from zero are infinite and come last."""
    return yoy.orderBy(
        F.col("change_pct").asc_nulls_last(), F.col("is_new_from_zero").desc(), entity, category, period
    ).limit(k)


def compare_periods(
    df: DataFrame,
    before: int,
    after: int,
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Category totals of two periods side by side, 0 where one lacks the category.

    One pass of conditional sums over the two periods; the period filter reaches
    the scan.
    """
    zero = F.lit(0).cast("bigint")

    def total_in(p: int):
        return F.coalesce(F.sum(F.when(F.col(period) == p, F.col(total))), zero)

    return (
        df.filter(F.col(period).isin(before, after))
        .groupBy(category)
        .agg(total_in(before).alias("before_total"), total_in(after).alias("after_total"))
        .withColumn("change_pct", pct_change_null(F.col("before_total"), F.col("after_total")))
    )


def dropped(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("change_pct") < 0)


def rose(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("change_pct") > 0)


def regime_means(
    df: DataFrame,
    cutoff: int,
    labels: Sequence[str] = ("before", "after"),
    by: Sequence[str] = (),
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Mean per panel *row* up to and after a cut-off period (not per yearly total)."""
    early, late = labels
    return (
        df.groupBy(*by, F.when(F.col(period) <= cutoff, early).otherwise(late).alias("regime"))
        .agg(F.count(total).alias("rows"), F.sum(total).alias("_sum"))
        .select(*by, "regime", "rows", F.try_divide("_sum", "rows").alias("mean_total"))
    )
