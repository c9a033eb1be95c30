import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.master": "local[4]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g",
    }
    found = SparkSession.builder.config(map=conf).getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
