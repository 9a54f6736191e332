import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work"))).getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """``apply(f, values)``: the column function over a list of texts, as Python values."""
    def run(f, values):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(list(enumerate(values)), "id int, v string").repartition(3)
        return [r[0] for r in df.orderBy("id").select(f(F.col("v")).alias("out")).collect()]
    return run
