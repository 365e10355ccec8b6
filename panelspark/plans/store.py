"""A store of computed tables, kept by what they are computed from."""

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.plans.lineage import remove, shared_folder

_MARK = "_SUCCESS"
# Nodes of a plan whose rows are not in files: nothing says whether they are the same ones.
_ROWS_IN_MEMORY = ("LocalRelation", "LogicalRDD", "ExternalRDD", "LocalTableScan")


def _leaves(df: DataFrame) -> list:
    found = df._jdf.queryExecution().analyzed().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def plan_key(df: DataFrame, version: str = "") -> str:
    """A digest of what a frame computes, the same in every session: its plan without ids, and the options of its scans.

    Python functions count by their names; put a ``version`` beside them that changes with their code. Rows
    that the driver made are not in the plan, so a frame of such rows has no key.
    """
    spark = df.sparkSession
    setting = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(1 << 20))
    try:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        spark.conf.set(setting, before)
    scans = []
    for leaf in _leaves(df):
        if leaf.nodeName() in _ROWS_IN_MEMORY:
            raise ValueError(f"rows of {leaf.nodeName()} are in no file, so nothing tells whether they changed")
        if leaf.nodeName() == "LogicalRelation":
            relation = leaf.relation()
            options = sorted(str(relation.options()).split("(", 1)[-1].rstrip(")").split(", "))
            scans.append((str(relation.fileFormat()), relation.location().rootPaths().mkString(" "), relation.schema().json(), *options))
    # Names of lambda variables count up through a session.
    plan = re.sub(r"(?<=lambda )(\w+?)_\d+#\d+L?", r"\1", plan)
    return hashlib.sha256("\n".join([version, plan, *map(repr, scans)]).encode()).hexdigest()[:32]


def inputs_state(df: DataFrame) -> str:
    """A digest of the files that a frame scans: their paths, lengths and times. Contents are not read.

    The listings are summed up by a job; the driver sees a row for each scan.
    """
    spark = df.sparkSession
    parts = []
    for leaf in _leaves(df):
        if leaf.nodeName() != "LogicalRelation":
            continue
        paths = leaf.relation().location().rootPaths()
        roots = [paths.apply(i).toString() for i in range(paths.size())]
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([re.sub(r"([\\{}\[\]*?])", r"\\\1", r) for r in roots])
        hashed = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        parts.append(tuple(files.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(F.pmod(hashed, F.lit(1 << 31)))).first()))
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:32]


class TableStore:
    """Tables below one folder, each under the key of its plan and the state of that plan's input files."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_folder(spark).rstrip('/')}/panelspark-store").rstrip("/")

    def _children(self, path: str) -> list[str]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []

    def _table(self, folder: str) -> str | None:
        """The first whole table of a folder; two runs may have written the same one."""
        return next((f"{folder}/{c}" for c in self._children(folder) if _MARK in self._children(f"{folder}/{c}")), None)

    def load(self, df: DataFrame, version: str = "") -> DataFrame:
        """The frame's rows out of the store, where they are computed and written at the first call.

        A later call, in this session or another, reads the table and scans no input. If an input file was added,
        changed or removed since, the table is computed anew and the one before it removed; until
        then it stays readable. A run that fails leaves no table.
        """
        plan = f"{self.root}/{plan_key(df, version)}"
        folder = f"{plan}/{inputs_state(df)}"
        found = self._table(folder)
        if found is None:
            df.write.parquet(f"{folder}/{uuid.uuid4().hex}")
            found = self._table(folder)
            for other in self._children(plan):
                if f"{plan}/{other}" != folder:
                    remove(self.spark, f"{plan}/{other}")
        return self.spark.read.schema(df.schema).parquet(found)

    def forget(self, df: DataFrame, version: str = "") -> None:
        """Remove the frame's tables."""
        remove(self.spark, f"{self.root}/{plan_key(df, version)}")

    def clear(self) -> None:
        """Remove all tables."""
        remove(self.spark, self.root)
