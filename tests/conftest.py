"""One session for all tests; 4 shuffle partitions keep them quick."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"
TEST = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from listloom.session import build_session

    s = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """The value of a column expression over one row of strings."""
    from pyspark.sql import functions as F

    def value(make, *texts):
        df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
        return df.select(make(*(F.col(c) for c in df.columns)).alias("x")).first()[0]

    return value
