import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("quire-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from quire import configure

    yield configure(session)
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of string columns."""

    def run(build, **columns):
        from pyspark.sql import functions as F

        row = spark.range(1)
        for name, value in columns.items():
            row = row.withColumn(name, F.lit(value))
        return row.select(build().alias("v")).head()["v"]

    return run
