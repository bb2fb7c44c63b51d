"""Session helpers: one place for the configs every job relies on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "sluice", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC clock, AQE and no UI.

    On a cluster, pass ``master=None`` and let spark-submit decide. ``shuffle_partitions``
    is left to the session unless given; size it to roughly input bytes / 128 MiB (AQE only merges).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sluice`` importable on executors and in driver-side Python runners.

    The package is zipped once per application and added with ``addPyFile``
    (how a cluster job ships its code); its functions and classes are also
    pickled by value, for runners that start before the zip is on their path.
    """
    import zipfile

    import sluice
    from pyspark import cloudpickle

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    cloudpickle.register_pickle_by_value(sluice)
    root = os.path.dirname(os.path.abspath(sluice.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="sluice-pkg-"), "sluice.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def prepare_session(spark: SparkSession) -> None:
    """Settings every operator relies on, for sessions built elsewhere (e.g. by a driver)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)


def keep_methods_compiled(spark: SparkSession) -> None:
    """Generated methods stay within the 8,000 bytes of bytecode that the JVM compiles; it interprets longer ones.

    Spark then runs a stage whose fused method would be longer operator by operator, each split into smaller methods.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared, reliable folder there; we only create our own
    scratch folder when the setting is absent (local tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sluice-ckpt-", dir=os.environ.get("SLUICE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    ship_package(spark)
    return d


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads the table instead of recomputing the
    plan) and lets a two-pass algorithm read narrow columns from the first pass
    with column pruning.
    """
    import uuid
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._sluice_path = path
    on_path(df.sparkSession, path, lambda fs, p: fs.deleteOnExit(p))
    return table


def on_path(spark: SparkSession, path: str, action):
    """``action(file system, path)``, for whatever store Spark itself reaches the path by."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return action(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def make_folder(spark: SparkSession, path: str) -> None:
    """An empty folder for a file stream that may start before anything is written to it."""
    on_path(spark, path, lambda fs, p: fs.mkdirs(p))


def discard(*tables) -> None:
    """Remove tables written by ``materialize`` that no later plan reads (the others go when the session ends)."""
    for t in tables:
        on_path(t.sparkSession, t._sluice_path, lambda fs, p: fs.delete(p, True))
