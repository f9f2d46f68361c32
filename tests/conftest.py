from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

# Workers import the library, and functions that tests define.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parent), str(Path(__file__).parent.parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
