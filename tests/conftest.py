import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("panelspark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def panel_of(spark):
    """Rows of (entity, category, period, total[, source]) as a panel."""

    def make(rows):
        full = [(r[0], r[2], r[1], r[3], r[4] if len(r) > 4 else "s") for r in rows]
        return spark.createDataFrame(full, "entity string, period int, category string, total bigint, source string")

    return make


def as_dict(df, key):
    """{key: row as dict}, for small results."""
    return {r[key]: r.asDict() for r in df.collect()}
