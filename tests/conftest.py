import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from tabulark.session import build_session

    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        settings={"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """The value of one column expression over one text or number."""
    from pyspark.sql import functions as F

    def evaluate(make, given, kind="string"):
        rows = spark.range(1).select(F.lit(given).cast(kind).alias("x"))
        return rows.select(make("x").alias("y")).first()["y"]

    return evaluate
