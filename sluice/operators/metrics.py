"""Counters and histograms as grouped aggregates over triaged rows.

Label sets and inclusion rules follow the worker: duplicates count as received
but neither processed nor failed; unparseable, unknown and unrouted messages are
not received; a panic counts both as ``panic`` and ``processing_error``;
raw (unparsed) dead letters are not in the dead-letter counter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice import constants as K
from sluice.operators.dedup import CLAIMED


def _n():
    return F.count(F.lit(1)).alias("n")


def messages_received(t: DataFrame) -> DataFrame:
    return t.where("routed").groupBy("topic", "tenant_id").agg(_n())


def _ran(t: DataFrame) -> DataFrame:
    return t.where(F.col("routed") & (F.col("dedup_status") == CLAIMED))


def messages_processed(t: DataFrame) -> DataFrame:
    return _ran(t).where(F.col("error").isNull()).groupBy("topic", "event_type", "tenant_id").agg(_n())


def messages_failed(t: DataFrame) -> DataFrame:
    reasons = F.when(F.col("error_class") == K.EC_PANIC, F.array(F.lit("panic"), F.lit("processing_error"))) \
        .otherwise(F.array(F.lit("processing_error")))
    return (_ran(t).where(F.col("error").isNotNull()).select("topic", "event_type", "tenant_id",
                                                              F.explode(reasons).alias("reason"))
            .groupBy("topic", "event_type", "tenant_id", "reason").agg(_n()))


def messages_retried(t: DataFrame) -> DataFrame:
    return t.where(F.col("outcome") == K.RETRY).groupBy("topic", "event_type", "tenant_id").agg(_n())


def messages_dlq(t: DataFrame) -> DataFrame:
    return (t.where((F.col("outcome") == K.DLQ) & (F.col("dlq_kind") == "event"))
            .groupBy("topic", "event_type", "tenant_id").agg(_n()))


def processing_duration(t: DataFrame, duration_col: str = "duration_s",
                        buckets=K.HISTOGRAM_BUCKETS) -> DataFrame:
    """Cumulative bucket counts (``le``), plus sum and count, per (topic, event_type, processor)."""
    d = F.col(duration_col)
    aggs = [F.count_if(d <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(buckets)]
    g = _ran(t).groupBy("topic", "event_type", "processor").agg(
        *aggs, F.count(F.lit(1)).alias("count"), F.sum(d).alias("sum"))
    les = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("bucket_count"))
           for i, b in enumerate(buckets)]
    les.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return g.select("topic", "event_type", "processor", F.explode(F.array(*les)).alias("x"),
                    F.col("count").alias("total_count"), F.round(F.col("sum"), 6).alias("total_sum")) \
        .select("topic", "event_type", "processor", "x.le", "x.bucket_count", "total_count", "total_sum")


COUNTER = ["metric", "topic", "event_type", "tenant_id", "processor", "label"]


def counters(t: DataFrame, duration_col: str | None = "duration_s", buckets=K.HISTOGRAM_BUCKETS) -> DataFrame:
    """All counters and the histogram of a table or micro-batch in one long table, made in one pass: ``COUNTER`` labels, n, total.

    Rows of several batches add up by ``merge_counters``. A histogram row counts its bucket alone; ``histogram`` makes them cumulative.
    """
    ran = F.col("routed") & (F.col("dedup_status") == CLAIMED)
    fields = {"topic": "topic", "event_type": "event_type", "tenant_id": "tenant_id", "processor": "processor"}

    def hit(cond: Column, metric: str, own: list[str], label: Column | None = None, total: Column | None = None) -> Column:
        cols = [F.lit(metric).alias("metric")] + [(F.col(f) if f in own else F.lit(None)).cast("string").alias(f) for f in fields]
        return F.when(cond, F.struct(*cols, (label if label is not None else F.lit(None)).cast("string").alias("label"),
                                     (total if total is not None else F.lit(None)).cast("double").alias("total")))
    failed, all_of = ran & F.col("error").isNotNull(), ["topic", "event_type", "tenant_id"]
    hits = [hit(F.col("routed"), "messages_received", ["topic", "tenant_id"]),
            hit(ran & F.col("error").isNull(), "messages_processed", all_of),
            hit(failed, "messages_failed", all_of, F.lit("processing_error")),
            hit(failed & (F.col("error_class") == K.EC_PANIC), "messages_failed", all_of, F.lit("panic")),
            hit(F.col("outcome") == K.RETRY, "messages_retried", all_of),
            hit((F.col("outcome") == K.DLQ) & (F.col("dlq_kind") == "event"), "messages_dlq", all_of)]
    if duration_col:
        d, le = F.col(duration_col), F.lit("+Inf")
        for b in reversed(buckets):
            le = F.when(d <= F.lit(b), F.lit(str(b))).otherwise(le)
        hits.append(hit(ran & d.isNotNull(), "processing_duration", ["topic", "event_type", "processor"], le, d))
    every = t.select(F.explode(F.array(*hits)).alias("h")).where(F.col("h").isNotNull()).select("h.*")
    return every.groupBy(*COUNTER).agg(_n(), F.sum("total").alias("total"))


def merge_counters(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*COUNTER).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def histogram(merged: DataFrame, buckets=K.HISTOGRAM_BUCKETS) -> DataFrame:
    """``processing_duration``'s rows from merged counters."""
    of = ["topic", "event_type", "processor"]
    h = merged.where(F.col("metric") == "processing_duration")
    below = [F.coalesce(F.sum(F.when(F.col("label").isin([str(x) for x in buckets[: i + 1]]), F.col("n"))), F.lit(0)).alias(f"b{i}") for i in range(len(buckets))]
    g = h.groupBy(*of).agg(*below, F.sum("n").alias("count"), F.sum("total").alias("sum"))
    les = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(buckets)]
    les.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return g.select(*of, F.explode(F.array(*les)).alias("x"), F.col("count").alias("total_count"), F.round("sum", 6).alias("total_sum")) \
        .select(*of, "x.le", "x.bucket_count", "total_count", "total_sum")


def lane_load(t: DataFrame) -> DataFrame:
    """Per (topic, lane): messages, distinct keys and the hottest key (ties broken by key)."""
    per_key = t.where("routed").groupBy("topic", "lane", "affinity_key").agg(F.count(F.lit(1)).alias("c"))
    return per_key.groupBy("topic", "lane").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("keys"),
        F.max(F.struct(F.col("c"), F.col("affinity_key"))).alias("top")) \
        .select("topic", "lane", "n", "keys", F.col("top.affinity_key").alias("top_key"),
                F.col("top.c").alias("top_key_n"))


#: A frequent-items sketch of m counters misses a count by at most this times rows / m.
SKETCH_ERROR = 3.5


def hot_keys(t: DataFrame, k: int = 10, tracked: int = 10_000, group: str = "topic", key: str = "affinity_key") -> DataFrame:
    """(group, key, n, rank) of the ``k`` most frequent keys of each group, exact; ties by key.

    A sketch aggregate of ``tracked`` counters a group and task names candidates, so memory does not grow with the number of keys; a second
    pass counts the candidates alone. The sketch bounds the count of every key it does not name. Groups whose k-th
    exact count does not exceed that bound have no clear top; only these are counted key by key.
    """
    rows = t.where(F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("key"))
    wanted = min(tracked, 4 * k + 16)
    found = rows.groupBy("g").agg(F.expr(f"approx_top_k(key, {wanted}, {tracked})").alias("top"), F.count(F.lit(1)).alias("rows"))
    least = F.when(F.size("top") >= wanted, F.array_min(F.transform("top", lambda x: x["count"]))).otherwise(F.lit(0))
    from sluice.session import materialize
    found = materialize(found.select("g", F.greatest(least, F.col("rows") * SKETCH_ERROR / tracked).alias("bound"), F.transform("top", lambda x: x["item"]).alias("keys"),
                                     (F.size("top") >= wanted).alias("full")), "hot-candidates")
    named = found.select("g", F.explode("keys").alias("key"))
    counts = rows.join(named, ["g", "key"]).groupBy("g", "key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("g").orderBy(F.desc("n"), "key")
    best = materialize(counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "hot-best")
    # clear: k keys above the bound, or fewer keys than asked for in a group small enough for the sketch to name them all
    clear = best.groupBy("g").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("have")).join(found, "g") \
        .where(((F.col("have") == k) & (F.col("least") > F.col("bound"))) | (~F.col("full") & (F.col("bound") < 1))).select("g")
    flat = rows.join(clear, "g", "left_anti").groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(clear, "g", "left_semi").unionByName(flat).select(F.col("g").alias(group), F.col("key").alias(key), "n", "rank")
