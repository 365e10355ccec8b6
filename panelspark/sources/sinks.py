"""Writers. All write in parallel; none brings rows to the driver."""

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: Sequence = ()) -> None:
    """CSV with a header; quotes are doubled; sorted across files when ``order`` is given."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ("source", "period")) -> None:
    """Parquet partitioned for pruning by source and period.

    The rebalance hint gathers each partition's rows into few files and splits a
    partition that is much larger than the others.
    """
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """One JSON document per row; NULLs are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path within the file system of the machines, if it is there that Spark would write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _text_writer(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes runs of ``folder, value`` rows as a file each, which gets its name when it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out, files = None, None, 0
        draft = f".part-{TaskContext.get().taskAttemptId()}.txt"

        def close() -> None:
            out.close()
            os.replace(f"{root}/{known}/{draft}", f"{root}/{known}/part-00000.txt")

        for batch in batches:
            if not batch.num_rows:
                continue
            folder = batch.column("folder")
            cuts = [0, *(i + 1 for i in pc.indices_nonzero(pc.not_equal(folder[1:], folder[:-1])).to_pylist()), batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if folder[at].as_py() != known:
                    if out:
                        close()
                    known, files = folder[at].as_py(), files + 1
                    os.makedirs(f"{root}/{known}", exist_ok=True)
                    out = open(f"{root}/{known}/{draft}", "w", encoding="utf-8", newline="")
                out.writelines(f"{v or ''}\n" for v in batch.column("value").slice(at, to - at).to_pylist())
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return write


def write_texts(df: DataFrame, path: str, partition_by: Sequence[str], order: Sequence[str]) -> None:
    """A text file for each value of the columns ``partition_by``, in folders named by them, out of the column ``value``.

    The rows of a file are in one task, which ``order`` brings together and in order. In the machines' own file system the tasks write the files
    themselves: there Spark's writer starts a process or two for the permissions of every file, which takes most of the
    time if files are many and small. In any other store it writes them.
    """
    root = _local_path(df.sparkSession, path)
    if root is None:
        ordered = df.sortWithinPartitions(*partition_by, *order).select(*partition_by, "value")
        ordered.write.partitionBy(*partition_by).text(path)
        return
    names = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(_NO_VALUE))) for c in partition_by]
    written = df.sortWithinPartitions(*order).select(F.concat_ws("/", *names).alias("folder"), "value").mapInArrow(_text_writer(root), "files long")
    written.agg(F.sum("files")).collect()
    os.makedirs(root, exist_ok=True)
