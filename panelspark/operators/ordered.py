"""Ordering operators that stay distributed: global positions and top-k per group."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Splitters are searched in two steps of about this many comparisons each.
_STEP = 32


def _bucket_count(df: DataFrame) -> int:
    """Twice the session's shuffle partitions, within bounds: enough ranges for all tasks."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(_STEP, min(_STEP * _STEP, 2 * partitions))


def ordered_index(
    df: DataFrame,
    desc: str | None = None,
    asc: Sequence[str] = (),
    name: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Add the 1-based global position by ``desc`` (numeric, descending) then ``asc``.

    The position is exact and no ties are shared, but there is no
    single-partition window over the rows. Splitters drawn by key hash
    cut the order into ``buckets`` ranges of similar size; each range is numbered
    by its own task and shifted by the row count of the ranges before it. The
    splitters only balance the work, they do not affect the result. Sorting on
    the whole key splits runs of equal ``desc`` values too.
    """
    buckets = buckets or _bucket_count(df)
    fields = ([(-F.col(desc)).alias("d")] if desc else []) + [F.col(c).alias(f"a{i}") for i, c in enumerate(asc)]
    keyed = df.withColumn("_key", F.struct(*fields))
    splitters = (
        keyed.select("_key", F.xxhash64("_key").alias("_h"))
        .orderBy("_h")
        .limit(buckets - 1)
        .agg(F.array_sort(F.collect_list("_key")).alias("s"))
        .select(F.struct("s", F.expr(f"filter(s, (k, i) -> i % {_STEP} = 0)").alias("heads")))
    )
    # Number of splitters below the key: first among every 32nd, then in that one's
    # stretch. The one-element transform evaluates the key once per row. The coalesce
    # makes the bucket non-null, else the join below would add a null check that the
    # optimizer evaluates on the rows underneath the caller's aggregate.
    stretch = f"greatest(size(filter(_splits.heads, h -> h < k)) - 1, 0) * {_STEP}"
    below = f"size(filter(slice(_splits.s, f + 1, {_STEP}), s -> s < k))"
    bucket = F.expr(f"transform(array(_key), k -> transform(array({stretch}), f -> f + {below})[0])[0]")
    placed = (
        keyed.withColumn("_splits", splitters.scalar())
        .withColumn("_bucket", F.coalesce(bucket, F.lit(0)))
        .drop("_splits")
    )
    # At most `buckets` rows, so both the window and the broadcast are bounded.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    within = Window.partitionBy("_bucket").orderBy("_key")
    return (
        placed.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(shifts), "_bucket")
        .withColumn(name, F.col("_rn") + F.col("_shift"))
        .drop("_bucket", "_key", "_rn", "_shift")
    )


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    ties: Sequence[str],
    k: int,
    name: str = "rank",
) -> DataFrame:
    """The ``k`` largest rows of every group, numbered from 1; ties go by ``ties``.

    ``row_number() <= k`` is the shape for which Spark trims every group to ``k``
    rows inside each task before the shuffle, so a hot group costs at most ``k``
    rows per task. Keep this window free of other functions or that is lost.
    """
    w = Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last(), *ties)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """The first ``n`` rows after a sort, NULLs last."""
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(key, *ties).limit(n)


def sort_nulls_last(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by several keys; ``"-name"`` sorts descending; NULLs always come last."""
    return df.orderBy(
        *[F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]
    )
