import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace import configure  # noqa: E402
from millrace.schemas import ENVELOPE  # noqa: E402

NOON = dt.datetime(2024, 1, 15, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("millrace-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    configure(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def send(spark):
    """Envelopes from bodies (bytes or text), published at noon."""

    def make(*bodies, publish_time=NOON):
        rows = [
            (b if b is None or isinstance(b, bytes) else b.encode(), {}, str(i), publish_time)
            for i, b in enumerate(bodies)
        ]
        return spark.createDataFrame(rows, ENVELOPE)

    return make
