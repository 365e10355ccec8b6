"""Building a clean panel and the small cubes every analysis reads."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import presets
from panelspark.functions.labels import is_aggregate_name, map_value
from panelspark.functions.numeric import strip, to_count
from panelspark.operators.distinct import count_distinct, distinct_bitmaps


def union_sources(*sources: DataFrame) -> DataFrame:
    """Union by column name, nothing removed; missing columns become NULL.

    A column whose type differs between sources is taken as text, so that a dirty
    source neither fails the union nor loses its values before they are cleaned.
    """
    kinds: dict[str, set] = {}
    for df in sources:
        for f in df.schema:
            kinds.setdefault(f.name, set()).add(f.dataType)
    mixed = {c for c, types in kinds.items() if len(types) > 1}
    aligned = [
        df.withColumns({c: F.col(c).cast("string") for c in df.columns if c in mixed}) for df in sources
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def clean_panel(
    *sources: DataFrame,
    exclude: str = presets.AGGREGATE_PATTERN,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
    missing: str = "drop",
) -> DataFrame:
    """Merge sources and clean them row by row, without a shuffle.

    Rows lacking a key or a total are dropped (``missing="drop"``, for merging sources), or all
    rows stay and a missing total is 0 (``missing="zero"``, for loading a panel). Totals that are no number become
    0; entity names are trimmed; rows of aggregate names are dropped.
    """
    merged = union_sources(*sources)
    if missing == "drop":
        merged = merged.dropna(subset=[entity, period, category, total])
    elif missing != "zero":
        raise ValueError(missing)
    return merged.withColumns(
        {
            total: F.coalesce(to_count(F.col(total)), F.lit(0).cast("bigint")),
            period: F.col(period).cast("double").cast("int"),
            entity: strip(F.col(entity)),
        }
    ).filter(~F.coalesce(is_aggregate_name(F.col(entity), exclude), F.lit(False)))


def rename_entities(df: DataFrame, aliases: dict[str, str], entity: str = "entity") -> DataFrame:
    """Apply an alias table to entity names; unlisted names stay. Off unless called."""
    return df.withColumn(entity, map_value(F.col(entity), aliases, keep_unmatched=True))


def count_labels(df: DataFrame, column: str, labels: Sequence[str], name: str = "entities") -> DataFrame:
    """Rows per label of a fixed list, 0 for labels that do not occur; other values are not counted."""
    listed = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias(column))
    counts = df.filter(F.col(column).isin(*labels)).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    # One row per label.
    return listed.join(F.broadcast(counts), column, "left").select(column, F.coalesce("_n", F.lit(0)).alias(name))


def cube(df: DataFrame, keys: Sequence[str], total: str = "total") -> DataFrame:
    """Sum of ``total`` per key. Summed inside each task first, so hot keys shuffle few rows."""
    return df.groupBy(*keys).agg(F.sum(total).alias(total))


def panel_ends(cells: DataFrame, period: str = "period", total: str = "total") -> tuple[Column, Column]:
    """First and last period of a cube as scalar subqueries.

    Taking the total along keeps the subqueries on the same columns as the cube
    itself, so they reuse its shuffle; the bare period would be a second scan.
    """
    ends = F.struct(period, total)
    return (
        cells.agg(F.min(ends).alias("e")).select(F.col("e")[period]).scalar(),
        cells.agg(F.max(ends).alias("e")).select(F.col("e")[period]).scalar(),
    )


def wide_matrix(
    df: DataFrame,
    rows: Sequence[str],
    columns: str,
    values: Sequence | None = None,
    total: str = "total",
) -> DataFrame:
    """One row per ``rows`` key, one column per value of ``columns``, gaps filled with 0.

    Conditional sums need one shuffle, on the row key. Pass ``values`` where they
    are known; otherwise they are looked up first. They become columns, so more
    than the session's limit for pivots is an error.
    """
    if values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = df.select(columns).dropna().distinct().orderBy(columns).limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{columns} has more than {most} values, too many for columns")
        values = [r[0] for r in found]
    zero = F.lit(0).cast("bigint")
    cells = [
        F.coalesce(F.sum(F.when(F.col(columns) == F.lit(v), F.col(total))), zero).alias(str(v)) for v in values
    ]
    return df.groupBy(*rows).agg(*cells)


def panel_overview(
    df: DataFrame,
    entity: str = "entity",
    category: str = "category",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """One row: rows, distinct keys, period range and grand total.

    The panel is summed to its grain first, inside each task; distinct keys are counted by bitmaps over their codes, so no
    row is expanded for each key that is counted.
    """
    grain = df.groupBy(entity, category, period).agg(F.count(F.lit(1)).alias("_n"), F.sum(total).alias(total))
    keys = {entity: "entities", category: "categories", period: "periods"}
    counts = count_distinct(distinct_bitmaps(grain, list(keys)), list(keys)).withColumnsRenamed(keys)
    sums = grain.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        F.sum(total).alias("total"),
    )
    # One row each.
    both = sums.withColumn("_c", counts.select(F.struct(*keys.values()).alias("c")).scalar())
    return both.select("rows", *[F.col(f"_c.{c}").alias(c) for c in keys.values()], "first_period", "last_period", "total")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, sorted."""
    return df.select(column).distinct().orderBy(column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; NULL is not counted."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
