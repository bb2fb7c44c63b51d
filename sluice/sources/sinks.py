"""Writers for retry, dead-letter and republish records (``sink_topic, sink_key, sink_value``).

* Kafka: one write with a per-row ``topic`` column (needs the spark-sql-kafka connector).
* Files: parquet partitioned by ``sink_topic``; with ``batch_id`` a batch counts once, however often it is
  written (``commit_batch``).

A batch is committed in two steps. Spark's writer makes its files final in a folder of this attempt; then an empty file
``_commits/<batch id>.<attempt>`` is created, in one atomic step on the driver. Readers list the commits and read only the folders they name
(``read_committed``), so a batch that was killed before its commit is not seen at all, a replayed one is seen once, and nobody
ever sees half a batch. What an attempt without a commit left behind is removed when its batch is committed.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import on_path


def _names(spark: SparkSession, folder: str) -> list[str]:
    return on_path(spark, folder, lambda fs, p: [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else [])


def committed(spark: SparkSession, path: str) -> dict[int, str]:
    """Batch id -> the attempt that was committed."""
    return {int(b): a for b, _, a in (n.partition(".") for n in _names(spark, f"{path}/_commits")) if b.isdigit()}


def commit_batch(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> bool:
    """Write a batch below ``path`` and commit it; False if it was committed before (nothing is written then)."""
    spark = df.sparkSession
    if batch_id in committed(spark, path):
        return False
    attempt = uuid.uuid4().hex[:12]
    df.write.partitionBy(*partition_by).parquet(f"{path}/data/attempt={batch_id}-{attempt}")
    on_path(spark, f"{path}/_commits/{batch_id}.{attempt}", lambda fs, p: fs.create(p, False).close())
    for name in _names(spark, f"{path}/data"):
        if name.startswith(f"attempt={batch_id}-") and not name.endswith(attempt):
            on_path(spark, f"{path}/data/{name}", lambda fs, p: fs.delete(p, True))
    return True


def read_committed(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All committed batches, with ``batch``, the batch id. ``schema`` is needed where nothing may be committed yet."""
    folders = [f"{path}/data/attempt={b}-{a}" for b, a in sorted(committed(spark, path).items())]
    if not folders:
        if schema is None:
            raise AnalysisException(f"no committed batch below {path}")
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("bigint"))
    reader = spark.read.option("basePath", f"{path}/data").option("mergeSchema", "false")
    if schema is not None:  # named here too: batches without rows leave no file to tell the folder's column from
        reader = reader.schema(spark.createDataFrame([], schema).schema.add("attempt", T.StringType()))
    df = reader.parquet(*folders)
    return df.withColumn("batch", F.split("attempt", "-")[0].cast("bigint")).drop("attempt")


def write_records(records: DataFrame, *, path: str | None = None, bootstrap: str | None = None,
                  batch_id: int | None = None, options: dict | None = None) -> None:
    if bootstrap:
        (records.select(F.col("sink_topic").alias("topic"), F.col("sink_key").cast("binary").alias("key"),
                        F.col("sink_value").cast("binary").alias("value"))
         .write.format("kafka").option("kafka.bootstrap.servers", bootstrap).options(**(options or {})).save())
        return
    if path is None:
        raise ValueError("give a path or bootstrap servers")
    rows = records.select("sink_topic", "sink_key", "sink_value")
    if batch_id is not None:
        commit_batch(rows, path, batch_id, ["sink_topic"])
    else:
        rows.write.mode("append").partitionBy("sink_topic").parquet(path)


def write_retry(records: DataFrame, **kw) -> None:
    write_records(records.where(F.col("sink_topic").endswith(".retry")), **kw)


def write_dlq(records: DataFrame, **kw) -> None:
    write_records(records.where(F.col("sink_topic").endswith(".dlq")), **kw)


def write_republished(records: DataFrame, **kw) -> None:
    write_records(records, **kw)
