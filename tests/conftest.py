import atexit
from functools import cache

import pytest
from pyspark.sql import SparkSession


@cache
def session() -> SparkSession:
    """One small session for all tests."""
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    made = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    atexit.register(made.stop)
    return made


@pytest.fixture
def spark() -> SparkSession:
    return session()
