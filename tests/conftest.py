import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def policy():
    from aeroweave.fixtures import synthetic_utility
    from aeroweave.plans import TablePolicy

    return TablePolicy(synthetic_utility())


@pytest.fixture(scope="session")
def make_flights(spark):
    """Flight states from ``(conflict_id, lat, lon, heading, speed)`` tuples, positions in order."""

    def build(rows):
        seen = {}
        out = []
        for conflict, lat, lon, heading, speed in rows:
            position = seen[conflict] = seen.get(conflict, -1) + 1
            out.append(
                (conflict, f"{conflict}-{position}", position, float(lat), float(lon), float(heading), float(speed))
            )
        return spark.createDataFrame(
            out, "conflict_id string, flight_id string, ord bigint, lat double, lon double, heading double, speed double"
        )

    return build
