"""Lookups: handler registry by (event_type, version) and worker pool by topic.

Both lookup tables are configuration (one row per registered handler / topic),
so their size is bounded by the deployment, not by the data; they are broadcast
after a row-count check, and joined by shuffle if a table is ever larger.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import constants as K

REGISTRY_DDL = "event_type STRING, version BIGINT, processor STRING"
TOPICS_DDL = "topic STRING, lanes INT"
# A registry or topic table bigger than this is not configuration; refuse to broadcast it.
MAX_LOOKUP_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Broadcast ``df`` only when it holds at most ``max_rows`` rows; otherwise leave it to a shuffle join.

    ``source`` is the table ``df`` was projected from. Frames built here from
    driver-side lists carry their row count; any other table is counted, reading
    at most ``max_rows + 1`` rows.
    """
    src = df if source is None else source
    n = getattr(src, "_sluice_rows", None)
    if n is None:
        n = src.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def registry_frame(spark: SparkSession, entries: Iterable[tuple[str, int]] = K.REGISTRY,
                   processors: Mapping[tuple[str, int], str] | None = None) -> DataFrame:
    rows = [(t, int(v), (processors or {}).get((t, v), t)) for t, v in entries]
    df = spark.createDataFrame(rows, REGISTRY_DDL)
    df._sluice_rows = len(rows)  # size known on the driver: no count job needed
    return df


def topics_frame(spark: SparkSession, lanes: Mapping[str, int] = K.LANES) -> DataFrame:
    df = spark.createDataFrame([(t, int(n)) for t, n in lanes.items()], TOPICS_DDL)
    df._sluice_rows = len(lanes)
    return df


def registered_twice(registry: DataFrame) -> DataFrame:
    """(event_type, version, n) of the pairs with more than one row."""
    return registry.groupBy("event_type", "version").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_registry_unique(registry: DataFrame) -> None:
    """A (type, version) registered twice is a wiring error: raise, like the worker does at start."""
    dup = registered_twice(registry).limit(1).collect()
    if dup:
        r = dup[0]
        raise ValueError(f"registry: duplicate processor for {r['event_type']} v{r['version']}")


def resolve_processor(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Left lookup of ``processor``; NULL when no handler is registered."""
    reg = registry.select("event_type", F.col("version").cast("bigint").alias("version"), "processor")
    return events.join(bounded_broadcast(reg, source=registry), ["event_type", "version"], "left")


def unknown_type_reason() -> F.Column:
    return F.concat(F.lit(K.UNKNOWN_TYPE), F.col("event_type"), F.lit(" v"), F.col("version").cast("string"))


def unknown_event_types(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events without a registered handler, with their dead-letter reason."""
    reg = registry.select("event_type", F.col("version").cast("bigint").alias("version"))
    return (events.join(bounded_broadcast(reg, source=registry), ["event_type", "version"], "left_anti")
            .withColumn("reason", unknown_type_reason()))


def has_processor(events: DataFrame, registry: DataFrame) -> DataFrame:
    reg = registry.select("event_type", F.col("version").cast("bigint").alias("version"))
    return events.join(bounded_broadcast(reg, source=registry), ["event_type", "version"], "left_semi")


def route_topics(events: DataFrame, topics: DataFrame) -> DataFrame:
    """Attach the lane count of the topic's worker pool (NULL: no pool)."""
    return events.join(bounded_broadcast(topics.select("topic", "lanes"), source=topics), "topic", "left")


def unrouted_topics(events: DataFrame, topics: DataFrame) -> DataFrame:
    return (events.join(bounded_broadcast(topics.select("topic"), source=topics), "topic", "left_anti")
            .withColumn("reason", F.lit(K.NO_POOL)))
