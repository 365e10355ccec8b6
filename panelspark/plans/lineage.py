"""Materialising intermediate tables that several jobs read, in a folder that a run can remove."""

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Asking changes nothing in the session or its context; without either there is no folder to write to.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    return folder


def has_shared_folder(spark: SparkSession) -> bool:
    return (spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()) is not None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a run wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class RunFolder:
    """A folder of one run below the shared one; leaving the ``with`` block removes it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/panelspark-run-{uuid.uuid4().hex}"

    def __enter__(self) -> "RunFolder":
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.path)


def materialise(df: DataFrame, folder: RunFolder | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder, or a run's, and read them back.

    Cuts the lineage and survives the loss of executors. Unlike a cached or
    checkpointed frame, what is read back is columnar, prunes and filters at the
    scan, and has a known size for join planning.
    """
    spark = df.sparkSession
    root = folder.path if folder else shared_folder(spark).rstrip("/")
    path = f"{root}/panelspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
