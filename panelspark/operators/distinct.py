"""Exact distinct counts that merge: bitmaps over the codes of sorted values."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ordered import ordered_index


def value_codes(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The distinct ``by`` and value rows of a table, with ``code``, the value's place among all sorted values from 0.

    NULL has no code. Rows are made distinct in each task before the shuffle, so a value that a third of all rows hold is a row per task;
    the codes are numbered in ranges by many tasks.
    """
    seen = df.select(*by, column).filter(F.col(column).isNotNull()).distinct()
    values = ordered_index(seen.select(column).distinct(), asc=[column], name="code")
    return seen.join(values.withColumn("code", F.col("code") - 1), column)


def distinct_bitmaps(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., column, bucket, bits``: which values of each column occur, a bit for each.

    A bucket is a bitmap of 32,768 codes. Bitmaps of any parts of the table merge by "or", so they count exactly for
    any union of ``by`` groups, and are stored in place of its rows. All must come from one call, which numbers the values.
    """
    parts = []
    for name in columns:
        coded = value_codes(df, name, by)
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits")
        parts.append(coded.groupBy(*by, F.lit(name).alias("column"), F.bitmap_bucket_number("code").alias("bucket")).agg(bits))
    return reduce(DataFrame.unionByName, parts)


def merge_bitmaps(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The bitmaps of larger groups: ``by`` has columns of the table that the merged rows still tell apart."""
    return bitmaps.groupBy(*by, "column", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_distinct(bitmaps: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The exact number of distinct values of each column, as a column of its own, per ``by`` group or in all.

    Groups without any bitmap have no row; without ``by`` there is one row always.
    """
    merged = merge_bitmaps(bitmaps, by).select(*by, "column", F.bitmap_count("bits").alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("column") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(c) for c in columns]
    return merged.groupBy(*by).agg(*sums)


def running_distinct(bitmaps: DataFrame, columns: Sequence[str], period: str) -> DataFrame:
    """Per period the number of distinct values up to it, from bitmaps by period.

    A bitmap counts in its own period and all later ones; periods are an axis of few values.
    """
    # A row per period, as the axis of the result.
    periods = bitmaps.agg(F.array_sort(F.collect_set(period)).alias("p")).scalar()
    later = bitmaps.withColumn("_periods", periods).withColumn("_upto", F.explode(F.filter("_periods", lambda p: p >= F.col(period))))
    return count_distinct(later.drop(period, "_periods").withColumnRenamed("_upto", period), columns, by=[period])
