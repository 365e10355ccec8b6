"""Roll-up of entities to groups through a lookup."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.panel import cube
from panelspark.schema import LOOKUP


def lookup_from_dict(spark: SparkSession, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{group: [members]}`` as a (group, member) table; a member listed twice belongs to the later group."""
    inverse = {m.lower(): (g, m) for g, members in groups.items() for m in members}
    return spark.createDataFrame(list(inverse.values()), LOOKUP)


def lookup_from_arrays(df: DataFrame, group: str = "group", members: str = "members") -> DataFrame:
    """A table of (group, array of members) as a (group, member) table."""
    return df.select(F.col(group).alias("group"), F.explode(members).alias("member"))


def attach_group(
    df: DataFrame, lookup: DataFrame, default: str = "Other", entity: str = "entity"
) -> DataFrame:
    """Add ``group`` by case-insensitive member name; unmatched entities get the default.

    No join hint: Spark broadcasts the lookup when its size allows it.
    """
    unique = lookup.groupBy(F.lower("member").alias("_member")).agg(F.max("group").alias("_group"))
    return (
        df.join(unique, F.lower(F.col(entity)) == F.col("_member"), "left")
        .withColumn("group", F.coalesce("_group", F.lit(default)))
        .drop("_member", "_group")
    )


def group_rollup(
    df: DataFrame,
    lookup: DataFrame,
    default: str = "Other",
    entity: str = "entity",
    period: str = "period",
    total: str = "total",
) -> DataFrame:
    """Total per group and period. Summed per entity first, so the join sees cube rows, not panel rows."""
    return cube(
        attach_group(cube(df, [entity, period], total), lookup, default, entity), ["group", period], total
    )


def group_totals(
    df: DataFrame, lookup: DataFrame, default: str = "Other", entity: str = "entity", total: str = "total"
) -> DataFrame:
    return cube(attach_group(cube(df, [entity], total), lookup, default, entity), ["group"], total)
