"""Helpers the operators share: scratch tables, bounded broadcasts, Arrow slices."""

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.plans.lineage import shared_folder

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# A side of at most this many rows, and bytes of its files' columns, may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# Rows of an Arrow batch. Ten thousand texts, the default, take a buffer of up to a hundred megabytes in the JVM and another in the worker.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULT_BATCH = "10000"
# Texts are worked on in slices of about this many bytes, however many rows a batch has.
SLICE_BYTES = 1 << 20


class Scratch:
    """Tables in a run folder of the shared folder, so that lost executors cost no more than their tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def local_path(self, name: str) -> str | None:
        """The path within the file system of the machines, if the shared folder is there."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        uri = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage cut, columnar, with a known size."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later job reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.

    A frame that is collected here should not be collected again, which would shuffle anew.
    """
    before = spark.conf.get(_FREEING, None)
    spark.conf.set(_FREEING, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREEING) if before is None else spark.conf.set(_FREEING, before)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table for broadcast if it is proven to have at most ``limit`` rows and ``BROADCAST_BYTES`` bytes.

    A larger one is returned as it is and joins by shuffle, where the adaptive
    skew join splits hot keys.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(limit + 1).count() <= limit else df


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where the texts of a slice reach ``limit`` bytes; no text is cut."""
    for batch in batches:
        sizes = np.fromiter(
            (0 if n is None else n for n in _byte_lengths(batch.column(column))), dtype=np.int64, count=batch.num_rows
        )
        ends = np.cumsum(sizes + 16) // limit
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def _byte_lengths(column: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def importable(spark: SparkSession) -> None:
    """Put this package on the workers' path where it is installed at the same place.

    On a cluster where it is not, ship it with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, *paths]))


def map_arrow(df: DataFrame, make: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of this package that turns an iterator of batches into batches.

    The session's batches get ``BATCH_ROWS`` rows, unless they have been given another number than the default.
    """
    spark = df.sparkSession
    importable(spark)
    if spark.conf.get(_BATCH_SETTING) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(make, schema)


def _literal(value) -> str:
    """A value as SQL."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return f"{value}L" if isinstance(value, int) and abs(value) > 0x7FFFFFFF else str(value)


def constant_array(values: list) -> Column:
    """An array of given values."""
    return F.expr(f"array({', '.join(map(_literal, values))})")


def constant_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of given values, marked for broadcast."""
    values = ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)
    return F.broadcast(spark.sql(f"VALUES {values} AS t({', '.join(names)})"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of rows with equal keys, each as one table, of batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            run = tuple(values[:, start].tolist())
            if held and run != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = run
            held.append(batch.slice(start, stop - start))
    if held:
        yield current, pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a run of rows with equal keys does; a run is held until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys])
        last = np.flatnonzero((values != values[:, -1:]).any(axis=0))
        start = int(last[-1]) + 1 if len(last) else 0
        if start:  # a run begins within the batch, so what is held has ended
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        elif held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in keys):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def matching(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is (``left_semi``) or is not (``left_anti``) in the one column of a table.

    The column gets a name that ``docs`` does not have, so that any columns may come along.
    """
    name = "_key"
    while name in docs.columns:
        name += "_"
    return docs.join(small_side(keys.toDF(name)), key == F.col(name), how)
