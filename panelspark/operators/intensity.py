"""Normalised intensity per period and risk levels."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import presets
from panelspark.functions.labels import right_closed_bin
from panelspark.functions.numeric import round_scaled
from panelspark.operators.panel import count_labels, cube


def intensity_scores(
    df: DataFrame, entity: str = "entity", period: str = "period", total: str = "total"
) -> DataFrame:
    """Entity totals per period scaled to 0-100 between the period's smallest and largest.

    NULL where a period has no spread. The extremes are a grouped aggregate, one row per
    period, and enter as a scalar subquery that maps period to extremes: periods are
    an axis of the panel and few, so neither a window nor a join brings all entities of one to a single task.
    """
    cells = cube(df, [entity, period], total).filter(F.col(period).isNotNull())
    ends = cells.groupBy(period).agg(F.struct(F.min(total).alias("lo"), F.max(total).alias("hi")).alias("ends"))
    by_period = ends.agg(F.map_from_entries(F.collect_list(F.struct(period, "ends")))).scalar()
    placed = cells.withColumn("_all", by_period).withColumn("_e", F.try_element_at("_all", period))
    score = F.try_divide(F.col(total) - F.col("_e.lo"), F.col("_e.hi") - F.col("_e.lo")) * 100.0
    return placed.select(period, entity, total, round_scaled(score, 1).alias("intensity"))


def risk_levels(
    scores: DataFrame,
    edges: Sequence[float] = presets.RISK_EDGES,
    labels: Sequence[str] = presets.RISK_LABELS,
    entity: str = "entity",
) -> DataFrame:
    """Mean intensity per entity and its risk level; intervals are right-closed, exactly 0 has none.

    Scores have one decimal, so tenths are summed as integers: the mean does not
    depend on the order of addition.
    """
    tenths = F.sum(F.rint(F.col("intensity") * 10).cast("bigint"))
    mean = F.try_divide(tenths / F.lit(10.0), F.count("intensity"))
    return (
        scores.groupBy(entity)
        .agg(round_scaled(mean, 1).alias("avg_intensity"))
        .withColumn("risk_level", right_closed_bin(F.col("avg_intensity"), edges, labels))
    )


def risk_distribution(levels: DataFrame, labels: Sequence[str] = presets.RISK_LABELS) -> DataFrame:
    """Entities per risk level, 0 for a level without any; entities without a level are not counted."""
    return count_labels(levels, "risk_level", labels)
