"""Intermediate tables in the cluster's shared folder.

A written table cuts lineage: a lost executor re-reads it instead of recomputing
the plan. Tables go below ``spark.checkpoint.dir``; the folder is removed when
the session ends, and single tables as soon as nothing reads them any more.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a new local one only for a local master without it."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="llm-tables-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Rows and bytes that Spark hands to Python at once: whole texts are long, its defaults are meant for short rows.
BATCH_ROWS, BATCH_BYTES = 2500, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes, unless the session asks for less.

    The settings stay, as the plans that operators return read them when they run.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Tables:
    """The intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = self._path(self.root)
        self._fs(path).deleteOnExit(path)

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back."""
        w = df.write
        if compression:
            w = w.option("compression", compression)
        w.parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        path = self._path(self.path(name))
        self._fs(path).delete(path, True)


#: Input bytes that a shuffle partition is meant for, where the session's number would make it larger.
PART_BYTES = 1 << 27


def input_bytes(df: DataFrame) -> int:
    """Size of all that the plan of ``df`` reads, as Spark knows it; sources of unknown size (a stated size beyond 2**60) count nothing."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0
    return total


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Shuffle partitions the session asks for; more if ``df`` reads more than ``PART_BYTES`` for each."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return n if df is None else max(n, -(-input_bytes(df) // PART_BYTES))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df`` (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
