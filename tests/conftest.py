import os

import pytest
from pyspark.sql import SparkSession

from veritide.shipping import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master(f"local[{min(4, os.cpu_count() or 1)}]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)


@pytest.fixture(scope="session")
def sf():
    return SF
