import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TODAY = datetime.date(2024, 3, 31)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def column(spark):
    """Values of one expression over a column ``x`` of literal values, in order."""

    def values(make, inputs, of_type="string"):
        rows = [(i, x) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {of_type}")
        return [r[1] for r in sorted(df.select("i", make(df["x"]).alias("y")).collect())]

    return values


@pytest.fixture
def plan():
    """The physical plan of a frame, as text."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()
