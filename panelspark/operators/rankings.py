"""Rankings, top categories, concentration, peaks."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.labels import bar
from panelspark.functions.numeric import round_exact, round_scaled, share_pct
from panelspark.operators.ordered import ordered_index, top_k_per_group
from panelspark.operators.panel import cube


def entity_ranking(df: DataFrame, entity: str = "entity", total: str = "total") -> DataFrame:
    """Entities by falling total; the rank is a row number, equal totals go by name."""
    return ordered_index(cube(df, [entity], total), desc=total, asc=[entity])


def ranking_bars(ranking: DataFrame, width: int = 25, entity: str = "entity", total: str = "total") -> DataFrame:
    """A ranking with a text bar proportional to the largest total."""
    top = ranking.agg(F.max(total)).scalar()
    return ranking.withColumn("_top", top).select(
        "rank", entity, total, bar(F.col(total), F.col("_top"), width).alias("bar")
    )


def top_categories(
    df: DataFrame, k: int = 5, entity: str = "entity", category: str = "category", total: str = "total"
) -> DataFrame:
    """The ``k`` largest categories of every entity."""
    return top_k_per_group(cube(df, [entity, category], total), [entity], total, [category], k)


def signature_categories(
    df: DataFrame, k: int = 5, entity: str = "entity", category: str = "category", total: str = "total"
) -> DataFrame:
    """The ``k`` largest categories of every entity with their share of its total.

    The share's denominator is a separate sum instead of a window over the
    entity: both sides reduce before their shuffle, so an entity with very many
    categories is never gathered in one task.
    """
    cells = cube(df, [entity, category], total)
    wholes = cells.groupBy(entity).agg(F.sum(total).alias("_whole"))
    return (
        top_k_per_group(cells, [entity], total, [category], k)
        .join(wholes, entity)
        .select(entity, "rank", category, total, share_pct(F.col(total), F.col("_whole")).alias("share_pct"))
    )


def signature_summary(
    top: DataFrame, entity: str = "entity", category: str = "category", total: str = "total"
) -> DataFrame:
    """One line per entity of its top categories: ``name (1,234) | name (567)``. At most k entries per entity."""
    item = F.struct("rank", F.concat(F.col(category), F.lit(" ("), F.format_number(total, 0), F.lit(")")).alias("t"))
    return top.groupBy(entity).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " | ").alias("summary")
    )


def concentration(
    df: DataFrame,
    ks: Sequence[int] = (5, 10),
    entity: str = "entity",
    category: str = "category",
    total: str = "total",
) -> DataFrame:
    """Per category: share of its top-k entities, and its largest entity with share.

    Categories are few and entities many, so a window over a category would be
    one huge task; trimming to the largest k per task avoids it. Categories that
    sum to 0 are left out.
    """
    cells = cube(df, [category, entity], total)
    wholes = cells.groupBy(category).agg(F.sum(total).alias("_whole")).filter(F.col("_whole") != 0)
    tops = top_k_per_group(cells, [category], total, [entity], max(ks)).groupBy(category).agg(
        *[F.sum(F.when(F.col("rank") <= k, F.col(total))).alias(f"_top{k}") for k in ks],
        F.max(F.when(F.col("rank") == 1, F.col(entity))).alias("worst_entity"),
        F.max(F.when(F.col("rank") == 1, F.col(total))).alias("_worst"),
    )
    return tops.join(wholes, category).select(
        category,
        *[share_pct(F.col(f"_top{k}"), F.col("_whole"), round_scaled).alias(f"top{k}_pct") for k in ks],
        "worst_entity",
        share_pct(F.col("_worst"), F.col("_whole"), round_scaled).alias("worst_entity_pct"),
    )


def worst_entity(
    df: DataFrame, entity: str = "entity", category: str = "category", total: str = "total"
) -> DataFrame:
    """Per category: the entity with the largest total; of equal totals the first by name."""
    return top_k_per_group(cube(df, [category, entity], total), [category], total, [entity], 1).select(
        category, entity, total
    )


def peak_best(df: DataFrame, entity: str = "entity", period: str = "period", total: str = "total") -> DataFrame:
    """Per entity: largest and smallest period total and their ratio; of equals the earliest period."""
    return (
        cube(df, [entity, period], total)
        .groupBy(entity)
        .agg(
            F.max(F.struct(F.col(total).alias("v"), (-F.col(period)).alias("p"))).alias("_peak"),
            F.min(F.struct(F.col(total).alias("v"), F.col(period).alias("p"))).alias("_best"),
        )
        .select(
            entity,
            (-F.col("_peak.p")).alias("peak_period"),
            F.col("_peak.v").alias("peak_total"),
            F.col("_best.p").alias("best_period"),
            F.col("_best.v").alias("best_total"),
            F.when(F.col("_best.v") > 0, round_exact(F.try_divide(F.col("_peak.v"), F.col("_best.v")), 2))
            .otherwise(F.lit(0.0))
            .alias("peak_best_ratio"),
        )
    )
