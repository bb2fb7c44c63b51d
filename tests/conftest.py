import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sluice.session import get_spark
    s = get_spark("local[4]", app="sluice-tests", shuffle_partitions=4)
    yield s
    s.stop()


def raw_frame(spark, rows):
    """rows: (topic, partition, offset, value, 'YYYY-mm-dd HH:MM:SS') -> Kafka-shaped frame."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, v string, ts string")
    return df.select("topic", "partition", "offset", F.encode(F.lit("k"), "UTF-8").alias("key"),
                     F.encode("v", "UTF-8").alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))
