import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("riverlog-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Entries from JSON lines: make(line, ...) or make((line, extra...), cols=...)."""
    from riverlog.operators.parse import parse_logs
    from pyspark.sql import functions as F

    def build(*lines, source="test"):
        rows = [(line, position) for position, line in enumerate(lines)]
        df = spark.createDataFrame(rows, "value string, pos bigint")
        now = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
        return parse_logs(df, source=source, now=now)

    return build
