import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from staylens import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        4,
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a frame from rows and a schema text; ISO texts become timestamps."""

    def make(rows, schema):
        from pyspark.sql import functions as F

        stamps = []
        plain = []
        for part in schema.split(","):
            name, kind = part.split()
            if kind == "ts":
                stamps.append(name)
                kind = "string"
            plain.append(f"{name} {kind}")
        df = spark.createDataFrame(rows, ", ".join(plain))
        for name in stamps:
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
        return df

    return make
