"""Raw message sources: Kafka, file streams and batch tables with the Kafka columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import constants as K

RAW_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("timestamp", T.TimestampType()),
])


def all_topics(topics: Sequence[str] = K.MAIN_TOPICS) -> list[str]:
    return [*topics, *[t + K.RETRY_SUFFIX for t in topics]]


def read_messages(spark: SparkSession, *, bootstrap: str | None = None, path: str | None = None,
                  topics: Sequence[str] = K.MAIN_TOPICS, stream: bool = True,
                  options: dict | None = None) -> DataFrame:
    """Subscribe to the main topics and their ``.retry`` twins as one log of raw records.

    * ``bootstrap``: Kafka (needs the spark-sql-kafka connector on the classpath);
      ``maxOffsetsPerTrigger`` in ``options`` bounds each micro-batch.
    * ``path``: a folder of parquet files with the Kafka columns (file stream or
      batch) -- what the tests use, since no Kafka connector ships in this image.
    """
    opts = dict(options or {})
    if bootstrap:
        reader = spark.readStream if stream else spark.read
        df = (reader.format("kafka").option("kafka.bootstrap.servers", bootstrap)
              .option("subscribe", ",".join(all_topics(topics))).options(**opts).load())
        return df.select(*[c.name for c in RAW_SCHEMA.fields])
    if path is None:
        raise ValueError("give bootstrap servers or a path")
    if stream:
        return spark.readStream.schema(RAW_SCHEMA).options(**opts).parquet(path)
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def split_retry_topics(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main-topic rows, ``.retry``-topic rows)."""
    is_retry = F.col("topic").endswith(K.RETRY_SUFFIX)
    return raw.where(~is_retry), raw.where(is_retry)


def with_path(raw: DataFrame) -> DataFrame:
    """Tag each record with the path it takes: 'schedule' for ``.retry`` topics, else 'process'."""
    return raw.withColumn("path", F.when(F.col("topic").endswith(K.RETRY_SUFFIX), "schedule")
                          .otherwise("process"))
