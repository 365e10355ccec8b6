"""Report cards: first periods against last periods, graded."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark import presets
from panelspark.functions.labels import grade, label_letter, label_text, map_value, matches_any_prefix
from panelspark.functions.numeric import pct_change_guarded, round_scaled
from panelspark.operators.ordered import ordered_index
from panelspark.operators.panel import count_labels, cube


def first_last_means(
    df: DataFrame, k: int = 3, entity: str = "entity", period: str = "period", total: str = "total"
) -> DataFrame:
    """Per entity: number of periods, total, mean of its first and of its last ``k`` periods."""
    series = Window.partitionBy(entity)
    placed = cube(df, [entity, period], total).withColumns(
        {"_i": F.row_number().over(series.orderBy(period)), "_n": F.count(F.lit(1)).over(series)}
    )
    return (
        placed.groupBy(entity)
        .agg(
            F.max("_n").alias("periods"),
            F.sum(total).alias(total),
            (F.sum(F.when(F.col("_i") <= k, F.col(total))) / F.lit(float(k))).alias("first_mean"),
            (F.sum(F.when(F.col("_i") > F.col("_n") - k, F.col(total))) / F.lit(float(k))).alias("last_mean"),
        )
    )


def report_cards(
    df: DataFrame,
    k: int = 3,
    cuts: Sequence[float] = presets.GRADE_CUTS,
    entity: str = "entity",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Rank, total, first-k against last-k change and grade of every entity with ``k`` periods.

    Ranks count all entities, also those too short for a card. Rank and means come from one aggregate per entity.
    """
    change = pct_change_guarded(F.col("first_mean"), F.col("last_mean"), rounding=round_scaled)
    stats = first_last_means(df, k, entity, period, total)
    return (
        ordered_index(stats, desc=total, asc=[entity], name="overall_rank")
        .filter(F.col("periods") >= k)
        .withColumn("trend_pct", change)
        .select(
            entity,
            "overall_rank",
            total,
            "trend_pct",
            grade(F.col("trend_pct"), cuts).alias("grade"),
            round_scaled(F.col("first_mean"), 0).alias("first_mean"),
            round_scaled(F.col("last_mean"), 0).alias("last_mean"),
        )
    )


def attach_ranks(df: DataFrame, ranks: DataFrame, entity: str = "entity", missing: int = 999) -> DataFrame:
    """Add ``overall_rank`` of a ranking that may lack some entities; those get ``missing``."""
    known = ranks.select(entity, F.col("rank").alias("overall_rank"))
    return df.join(known, entity, "left").withColumn("overall_rank", F.coalesce("overall_rank", F.lit(missing)))


def grade_distribution(cards: DataFrame) -> DataFrame:
    """Cards per grade letter, 0 for a grade without any."""
    letters = [label.split(" ")[0] for label in presets.GRADE_LABELS]
    return count_labels(cards.select(label_letter(F.col("grade")).alias("grade_letter")), "grade_letter", letters)


def filter_grades(cards: DataFrame, letters: Sequence[str]) -> DataFrame:
    """Cards with one of the grade letters, with letter, wording and colour split out."""
    return cards.filter(matches_any_prefix(F.col("grade"), letters)).withColumns(
        {
            "grade_letter": label_letter(F.col("grade")),
            "grade_text": label_text(F.col("grade")),
            "color": map_value(label_letter(F.col("grade")), presets.GRADE_COLORS),
        }
    )
