"""Data behind each dashboard page. Rendering is not part of this library."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import presets
from panelspark.functions.labels import map_value
from panelspark.functions.numeric import round_scaled
from panelspark.operators import changes
from panelspark.operators.ordered import top_k_per_group, top_n
from panelspark.operators.panel import cube, panel_ends, wide_matrix
from panelspark.operators.report_cards import report_cards


def kpis(
    df: DataFrame,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """One row: grand total, largest entity, largest category, latest period and its total.

    Grouping sets sum by entity, category and period in one scan and one shuffle;
    the winners are plain aggregates over those sums.
    """
    sums = df.groupingSets(
        [[F.col(entity)], [F.col(category)], [F.col(period)], []], entity, category, period
    ).agg(
        F.sum(total).alias("_t"),
        F.grouping(entity).alias("_e"),
        F.grouping(category).alias("_c"),
        F.grouping(period).alias("_p"),
    )
    by_entity = F.when(F.col("_e") == 0, F.struct((-F.col("_t")).alias("t"), F.col(entity).alias("k")))
    by_category = F.when(F.col("_c") == 0, F.struct((-F.col("_t")).alias("t"), F.col(category).alias("k")))
    by_period = F.when(F.col("_p") == 0, F.struct(F.col(period).alias("k"), F.col("_t").alias("t")))
    everything = (F.col("_e") == 1) & (F.col("_c") == 1) & (F.col("_p") == 1)
    return sums.agg(
        F.max(F.when(everything, F.col("_t"))).alias("total"),
        F.min(by_entity).alias("_we"),
        F.min(by_category).alias("_wc"),
        F.max(by_period).alias("_lp"),
    ).select(
        "total",
        F.col("_we.k").alias("worst_entity"),
        (-F.col("_we.t")).alias("worst_entity_total"),
        F.col("_wc.k").alias("top_category"),
        F.col("_lp.k").alias("latest_period"),
        F.col("_lp.t").alias("latest_total"),
    )


def latest_top(
    df: DataFrame, k: int = 10, category: str = "category", period: str = "period", total: str = "total"
) -> DataFrame:
    """Largest categories of the latest period.

    Sums come first and the latest period is picked by a conditional sum: a filter
    on it would be pushed below the sums, to a second scan of the panel.
    """
    cells = cube(df, [category, period], total)
    _, last = panel_ends(cells, period, total)
    latest = (
        cells.withColumn("_last", last)
        .groupBy(category)
        .agg(F.sum(F.when(F.col(period) == F.col("_last"), F.col(total))).alias(total))
        .filter(F.col(total).isNotNull())
    )
    return top_n(latest, total, k, [category])


def period_maps(
    df: DataFrame, entity: str = "entity", period: str = "period", total: str = "total"
) -> DataFrame:
    """Per entity a map period -> total. After the sums an entity has one entry per period."""
    entry = F.struct(F.col(period).cast("string").alias("p"), F.col(total).alias("t"))
    return (
        cube(df, [entity, period], total)
        .groupBy(entity)
        .agg(F.sum(total).alias(total), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("yearly"))
    )


def top_category_arrays(
    df: DataFrame, k: int = 5, entity: str = "entity", category: str = "category", total: str = "total"
) -> DataFrame:
    """Per entity its ``k`` largest categories as an array of (category, total)."""
    item = F.struct("rank", F.col(category).alias("category"), F.col(total).alias("total"))
    return (
        top_k_per_group(cube(df, [entity, category], total), [entity], total, [category], k)
        .groupBy(entity)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(item)), lambda x: F.struct(x["category"], x["total"])
            ).alias("top_categories")
        )
    )


def entity_profile(
    df: DataFrame,
    k: int = 10,
    signature_k: int = 5,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """One row per entity: totals by period, largest categories, signature, report card, all nested.

    All nested parts are bounded by the numbers of periods and categories or by ``k``. ``yoy`` holds the
    year-on-year change of every category, by period and category.
    """
    # The null check is the one the joins imply; stated here, all parts share one cube.
    cells = cube(df.filter(F.col(entity).isNotNull()), [entity, category, period], total)
    tops = top_category_arrays(cells, k, entity, category, total)
    cards = report_cards(cells, entity=entity, period=period, total=total).select(
        entity, F.struct("overall_rank", "trend_pct", "grade", "first_mean", "last_mean").alias("card")
    )
    row = F.struct(F.col(period).alias("period"), F.col(category).alias("category"), "change_pct")
    yoy = changes.yoy_changes(cells, cells=True, entity=entity, category=category, period=period, total=total)
    yoy = yoy.groupBy(entity).agg(F.array_sort(F.collect_list(row)).alias("yoy"))
    return (
        period_maps(cells, entity, period, total)
        .join(tops, entity)
        .join(cards, entity, "left")
        .join(yoy, entity, "left")
        .withColumn("signature", F.slice("top_categories", 1, signature_k))
        .withColumn("yoy", F.coalesce("yoy", F.array().cast(yoy.schema["yoy"].dataType)))
    )


def to_json_rows(df: DataFrame, key: str = "entity", name: str = "payload") -> DataFrame:
    """Key and all other columns as one JSON text; NULLs are written as null."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(name))


def heatmap(
    df: DataFrame,
    periods: Sequence[int] | None = None,
    only_entity: str | None = None,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Category x period totals of all entities or of one."""
    rows = df if only_entity is None else df.filter(F.col(entity) == only_entity)
    return wide_matrix(rows, [category], period, periods, total)


def category_series(
    df: DataFrame, which: str, category: str = "category", period: str = "period", total: str = "total"
) -> DataFrame:
    return cube(df.filter(F.col(category) == which), [period], total)


def category_top_entities(
    df: DataFrame, which: str, k: int = 15, entity: str = "entity", category: str = "category", total: str = "total"
) -> DataFrame:
    return top_n(cube(df.filter(F.col(category) == which), [entity], total), total, k, [entity])


def category_top_series(
    df: DataFrame,
    which: str,
    k: int = 10,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Series of the ``k`` largest entities of a category: the cube joined with its own top-k.

    The top-k names are unique, so an inner join is a semi-join here. A literal
    semi-join would be pushed below the cube's sum and scan the panel twice.
    """
    # The null check is the one the join implies; stated here, both sides scan alike and share it.
    chosen = df.filter((F.col(category) == which) & F.col(entity).isNotNull())
    cells = cube(chosen, [entity, period], total)
    best = top_n(cube(cells, [entity], total), total, k, [entity]).select(entity)
    # The right side has at most k rows.
    return cells.join(F.broadcast(best), entity).select(period, entity, total)


def compare_entities(
    df: DataFrame,
    entities: Sequence[str],
    which: str,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Series of the named entities for one category; both filters reach the scan."""
    chosen = df.filter(F.col(entity).isin(*entities) & (F.col(category) == which))
    return cube(chosen, [period, entity], total)


def category_share(df: DataFrame, k: int = 8, category: str = "category", total: str = "total") -> DataFrame:
    """Largest categories overall."""
    return top_n(cube(df, [category], total), total, k, [category])


def lowest_entities(df: DataFrame, k: int = 10, entity: str = "entity", total: str = "total") -> DataFrame:
    """Entities of the smallest totals."""
    return top_n(cube(df, [entity], total), total, k, [entity], ascending=True)


def top_intensity(levels: DataFrame, k: int = 40, entity: str = "entity") -> DataFrame:
    """Entities of the highest mean intensity, with the colour of their level."""
    return top_n(levels, "avg_intensity", k, [entity]).withColumn(
        "color", map_value(F.col("risk_level"), presets.RISK_COLORS)
    )


def forecast_by_entity(pred: DataFrame, k: int = 20) -> DataFrame:
    """Largest predicted totals by entity."""
    sums = pred.groupBy("entity").agg(F.sum("predicted").alias("predicted"))
    return top_n(sums, "predicted", k, ["entity"])


def forecast_compare(pred: DataFrame, k: int = 15) -> DataFrame:
    """Actual against predicted of the entities with the largest predictions."""
    sums = pred.groupBy("entity").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    return top_n(sums, "predicted", k, ["entity"])


def forecast_by_category(pred: DataFrame) -> DataFrame:
    """Actual, predicted and mean percent change by category.

    Changes have one decimal; their tenths are summed as integers, so the mean
    does not depend on the order of addition.
    """
    tenths = F.sum(F.rint(F.col("change_pct") * 10).cast("bigint"))
    return pred.groupBy("category").agg(
        F.sum("actual").alias("actual"),
        F.sum("predicted").alias("predicted"),
        round_scaled(tenths / F.lit(10.0) / F.count("change_pct"), 1).alias("avg_change"),
    )


_SALTS = 16


def choropleth(
    df: DataFrame,
    which: str,
    shape_rows: DataFrame,
    entity: str = "entity",
    category: str = "category",
    total: str = "total",
) -> DataFrame:
    """Total of one category per shape; shapes without data show 0 and ``matched`` is false.

    Shapes carry the panel's name in ``entity`` (see ``geometry.shapes``). Many shapes may share a name: totals are
    copied once per salt, and each shape meets the copy of its own salt.
    """
    totals = cube(df.filter(F.col(category) == which), [entity], total)
    named = shape_rows.select("name", F.col("entity").alias("_e"), F.pmod(F.xxhash64("name"), F.lit(_SALTS)).alias("_salt"))
    salted = totals.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return named.join(salted, (F.col("_e") == F.col(entity)) & (F.col("_salt") == F.col("_t")), "left").select(
        "name",
        F.col("_e").alias("entity"),
        F.coalesce(F.col(total), F.lit(0).cast("bigint")).alias("total"),
        F.col(total).isNotNull().alias("matched"),
    )


def find_column(df: DataFrame, part: str) -> str:
    """First column whose name contains ``part``."""
    return next(c for c in df.columns if part in c)


def read_published_forecast(df: DataFrame) -> DataFrame:
    """A forecast under its published names (``Actual_<latest>``, ``Predicted_<next>``) under the library's again.

    The period is the one in the predicted column's name.
    """
    actual, predicted = find_column(df, "Actual"), find_column(df, "Predicted")
    names = {v: k for k, v in presets.OUTPUT_COLUMNS["predictions"].items()}
    known = df.withColumnsRenamed({**names, actual: "actual", predicted: "predicted"})
    return known.withColumn("period", F.lit(int(predicted.split("_")[1])))


def label_columns(df: DataFrame, names: Mapping[str, str], **periods: int) -> DataFrame:
    """Rename columns for presentation; ``{first}`` and the like in a name stand for a period."""
    known = {k: v.format(**periods) for k, v in names.items() if "{" not in v or periods}
    return df.withColumnsRenamed(known)
