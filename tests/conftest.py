import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mediasift.session import build_session

    session = build_session(
        "mediasift-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluates one expression over one row of named values."""
    from pyspark.sql import functions as F

    def evaluate(build, **values):
        row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
        return row.select(build(*[F.col(c) for c in values]).alias("r")).first()["r"]

    return evaluate
