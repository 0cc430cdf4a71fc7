import os

import pytest
from pyspark.sql import SparkSession

from ledgerloom import scratch

SF_DIR = os.environ.get("LEDGERLOOM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ledgerloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    scratch.clear(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
