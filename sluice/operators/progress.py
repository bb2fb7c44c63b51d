"""Per-partition progress: commit frontier, newly movable frontiers, in-flight work, lag.

Input is a progress table ``(topic, partition, offset, completed)``: one row per
tracked record. All operators are grouped aggregates (partial aggregation on
the map side), so a hot partition is combined before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.scan import rank_within

TP = ["topic", "partition"]


def committable_offsets(progress: DataFrame) -> DataFrame:
    """Highest offset with every tracked offset before it completed (over present offsets).

    Reported only when it reaches the first tracked offset (otherwise nothing can be committed).
    """
    g = progress.groupBy(*TP).agg(
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
        F.min(F.when(~F.col("completed"), F.col("offset"))).alias("first_open"))
    frontier = F.coalesce(F.col("first_open") - 1, F.col("last_offset"))
    return (g.withColumn("committable", frontier)
            .where(F.col("committable") >= F.col("first_offset"))
            .select(*TP, "first_offset", "committable"))


def committable_offsets_strict(progress: DataFrame) -> DataFrame:
    """Like ``committable_offsets`` but a missing offset (hole) stops the frontier too."""
    r = rank_within(progress.select(*TP, "offset", "completed"), TP, ["offset"], out="rn")
    first = progress.groupBy(*TP).agg(F.min("offset").alias("first_offset"),
                                      F.max("offset").alias("last_offset"))
    j = r.join(first, TP)
    good = F.col("completed") & (F.col("offset") - F.col("rn") == F.col("first_offset") - 1)
    g = j.groupBy(*TP, "first_offset", "last_offset").agg(
        F.min(F.when(~good, F.col("rn"))).alias("bad_rn"))
    frontier = F.coalesce(F.col("first_offset") + F.col("bad_rn") - 2, F.col("last_offset"))
    return (g.withColumn("committable", frontier).where(F.col("committable") >= F.col("first_offset"))
            .select(*TP, "first_offset", "committable"))


def newly_committable(current: DataFrame, last: DataFrame) -> DataFrame:
    """Partitions whose frontier moved past the last flushed one."""
    prev = last.select(*TP, F.col("committable").alias("last_committed"))
    return (current.join(prev, TP, "left")
            .where(F.col("last_committed").isNull() | (F.col("committable") > F.col("last_committed")))
            .select(*TP, "committable", "last_committed"))


def in_flight(progress: DataFrame) -> DataFrame:
    return progress.groupBy(*TP).agg(F.count(F.lit(1)).alias("tracked"),
                                     F.count_if(~F.col("completed")).alias("in_flight"))


def consumer_lag(progress: DataFrame) -> DataFrame:
    """End of the tracked log minus the commit frontier (all tracked if nothing is committable)."""
    g = progress.groupBy(*TP).agg(F.min("offset").alias("first_offset"),
                                  F.max("offset").alias("last_offset"))
    c = committable_offsets(progress).select(*TP, "committable")
    return (g.join(c, TP, "left").select(
        *TP, (F.col("last_offset") - F.coalesce(F.col("committable"), F.col("first_offset") - 1))
        .alias("lag")))
