import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from metricloom.schema import REQUEST  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def requests_of(spark, tmp_path):
    """Requests given as Python dicts, through OTLP/JSON files."""

    def make(*requests):
        path = tmp_path / "requests.json"
        path.write_text("\n".join(json.dumps(r) for r in requests))
        return spark.read.schema(REQUEST).json(str(path))

    return make
