"""Events of one (topic, affinity key) in arrival order, across micro-batches.

Records of a key can sit in several partitions, and a micro-batch may be ahead on one of them. Rows therefore wait in a
buffer until no earlier one is expected: the frontier is the latest clock seen less ``wait_s``, and a micro-batch releases what the
buffer and its own rows hold up to there, in order of (clock, topic, partition, offset). Frontiers only rise, so the order is
(batch, rank in the batch). A row that comes after the frontier has passed it is released at once, behind those of earlier batches, and
marked ``late``; so is a row without a clock. No row is dropped.

Ranks come from the skew-safe scan, so a key with a third of all rows is spread over tasks; numbers over all batches (``read_ordered``) add
what earlier batches counted for the key. A stateful handler (``step``) must see a key's events one after the other: its rows are sorted
by Spark and streamed through one task, never held as a group, with the key's state as the first row.

The buffer, the counts and the handlers' states are tables committed by batch id (``sinks.commit_batch``). A batch that was killed is
computed again from the buffer its predecessor left and counts once; outputs and states of a batch are committed as one. A batch writes the
states of its own keys, and every ``COMPACT`` batches those of all keys.
"""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.ordering import ARRIVAL
from sluice.operators.scan import rank_within
from sluice.session import make_folder, on_path
from sluice.sources.sinks import commit_batch, committed, read_committed

#: (state of the key or None, the row) -> (new state, output); both are texts or None.
Step = Callable[[str | None, Mapping], tuple[str | None, str | None]]
COMPACT = 16
ADDED = {"order_key", "late", "rank", "seq", "batch", "attempt", "state", "is_state", "output", "error"}
STATES = "topic string, order_key string, state string, is_state boolean"
COUNTS = "topic string, order_key string, n bigint"


def _in_order(step: Step, columns: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        key, state, touched, kinds = None, None, False, None

        def left():
            """The state of the key whose rows have ended, as a batch of one row."""
            row = {"topic": key[0], "order_key": key[1], "state": state, "is_state": True}
            return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in kinds], names=[f.name for f in kinds])
        for b in batches:
            kinds = [*b.schema, pa.field("output", pa.string()), pa.field("error", pa.string())]
            output, error, is_state = [], [], b.column("is_state").to_pylist()
            for row in b.to_pylist():
                at = (row["topic"], row["order_key"])
                if at != key:
                    if touched:
                        yield left()
                    key, state, touched = at, None, True
                if row["is_state"]:
                    state = row["state"]
                    continue
                out, failed = None, None
                try:  # a failed event leaves its lane, the later ones of the key go on
                    state, out = step(state, {c: row[c] for c in columns})
                except Exception as e:
                    failed = f"{type(e).__name__}: {e}"
                output.append(out)
                error.append(failed)
            events = b.filter(pa.array([not x for x in is_state]))
            yield pa.RecordBatch.from_arrays([*events.columns, pa.array(output, pa.string()), pa.array(error, pa.string())], names=[f.name for f in kinds])
        if touched:
            yield left()
    return run


def handle_in_order(ranked: DataFrame, states: DataFrame, step: Step) -> DataFrame:
    """One batch's rows with ``output`` and ``error``, every key handled in order of ``rank``, and (``is_state``) the states of their keys and of ``states``.

    Both are one table, to be written as one: reading it twice would call the handlers twice.
    """
    plain = [f.name for f in ranked.schema.fields if f.name not in ("order_key", "rank", "late")]
    rows = ranked.select("*", F.lit(False).alias("is_state"), F.lit(None).cast("string").alias("state"))
    every = rows.unionByName(states.withColumns({"is_state": F.lit(True), "rank": F.lit(0).cast("bigint")}), allowMissingColumns=True)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in every.schema.fields]).add("output", "string").add("error", "string")
    return every.repartition("topic", "order_key").sortWithinPartitions("topic", "order_key", "rank").mapInArrow(_in_order(step, plain), schema)


def _states(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The last state of every key, from the last full table on."""
    done = [b for b in committed(spark, path) if b < before]
    base = max((b for b in done if b % COMPACT == 0), default=0)
    rows = read_committed(spark, path, STATES).where(F.col("is_state") & F.col("batch").between(base, before - 1))
    return rows.groupBy("topic", "order_key").agg(F.max_by("state", "batch").alias("state"))


def _frontier(spark: SparkSession, out_dir: str, before: int) -> int | None:
    done = read_committed(spark, os.path.join(out_dir, "frontier"), "frontier_us bigint")
    return done.where(F.col("batch") < before).agg(F.max("frontier_us")).first()[0]


def order_batch(rows: DataFrame, out_dir: str, batch_id: int, wait_s: int | None, key: str = "affinity_key", step: Step | None = None) -> None:
    """Take in one micro-batch and release what can't be overtaken any more (all, if ``wait_s`` is None).

    ``rows`` have topic, partition, offset, clock and ``key``; their other columns pass through, but for the names in ``ADDED``.
    """
    if clash := ADDED & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns {sorted(clash)} are added by the ordering")
    spark, at = rows.sparkSession, {n: os.path.join(out_dir, n) for n in ("held", "ordered", "handled", "counts", "frontier")}
    if batch_id in committed(spark, at["frontier"]):
        return
    was = _frontier(spark, out_dir, batch_id)
    held = read_committed(spark, at["held"], rows.schema).where(F.col("batch") == batch_id - 1).drop("batch")
    have = rows.unionByName(held).persist()
    try:
        last = have.agg(F.max(F.unix_micros("clock"))).first()[0]
        known = [x for x in (was, None if last is None else last - (wait_s or 0) * 1_000_000) if x is not None]
        to = max(known, default=None)
        clock = F.unix_micros("clock")
        free = F.lit(True) if wait_s is None else F.coalesce(clock <= F.lit(to), F.lit(True))
        late = F.coalesce(clock <= F.lit(was), F.col("clock").isNull()) if was is not None else F.col("clock").isNull()
        # a row that the buffer held is above the last frontier, so only new rows can be late
        out = have.where(free).withColumns({"order_key": F.col(key).cast("string"), "late": late})
        commit_batch(rank_within(out, ["topic", "order_key"], [c for c in ARRIVAL if c != "topic"], out="rank"), at["ordered"], batch_id)
        ranked = read_committed(spark, at["ordered"]).where(F.col("batch") == batch_id).drop("batch")
        commit_batch(ranked.groupBy("topic", "order_key").agg(F.count(F.lit(1)).alias("n")), at["counts"], batch_id)
        if step is not None:
            states = _states(spark, at["handled"], batch_id)
            if batch_id % COMPACT:
                states = states.join(ranked.select("topic", "order_key").distinct().withColumnsRenamed({"topic": "t_", "order_key": "k_"}),
                                     F.col("topic").eqNullSafe(F.col("t_")) & F.col("order_key").eqNullSafe(F.col("k_")), "left_semi")
            commit_batch(handle_in_order(ranked, states, step), at["handled"], batch_id, ["is_state"])
        commit_batch(have.where(~free), at["held"], batch_id)
        commit_batch(spark.createDataFrame([(to,)], "frontier_us bigint"), at["frontier"], batch_id)
    finally:
        have.unpersist()


def start_ordered_stream(rows: DataFrame, out_dir: str, checkpoint: str, wait_s: int = 600, key: str = "affinity_key", step: Step | None = None,
                         trigger: dict | None = None):
    """Order a stream of rows below ``out_dir``; returns the ``StreamingQuery``.

    ``wait_s`` is how far partitions may drift apart before a row counts as late. Each batch of ``held`` is the whole buffer,
    rows of the last ``wait_s`` seconds of log time.
    """
    spark = rows.sparkSession
    if _closed(spark, out_dir):
        raise ValueError(f"the ordered log below {out_dir} was finished")

    def write(batch: DataFrame, batch_id: int) -> None:
        order_batch(batch, out_dir, batch_id, wait_s, key, step)
    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _closed(spark: SparkSession, out_dir: str) -> bool:
    return on_path(spark, os.path.join(out_dir, "closed"), lambda fs, p: fs.exists(p))


def finish_ordered(spark: SparkSession, out_dir: str, schema: T.StructType, key: str = "affinity_key", step: Step | None = None) -> None:
    """Release what the buffer still holds, as a last batch; the log has ended and the stream can't be started again."""
    if not _closed(spark, out_dir):
        n = max(committed(spark, os.path.join(out_dir, "frontier")), default=-1) + 1
        order_batch(spark.createDataFrame([], schema), out_dir, n, None, key, step)
        make_folder(spark, os.path.join(out_dir, "closed"))


def read_ordered(spark: SparkSession, out_dir: str, handled: bool = False) -> DataFrame:
    """All released rows with ``seq``, their number in the key over all batches; with ``handled`` the handler's ``output`` and ``error``."""
    rows = read_committed(spark, os.path.join(out_dir, "handled" if handled else "ordered"))
    if handled:
        rows = rows.where("NOT is_state").drop("is_state", "state")
    before = Window.partitionBy("topic", "order_key").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    counts = read_committed(spark, os.path.join(out_dir, "counts"), COUNTS).select(
        F.col("topic").alias("c_topic"), F.col("order_key").alias("c_key"), F.col("batch").alias("c_batch"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    same = F.col("topic").eqNullSafe(F.col("c_topic")) & F.col("order_key").eqNullSafe(F.col("c_key")) & (F.col("batch") == F.col("c_batch"))
    return rows.join(counts, same).withColumn("seq", F.col("before") + F.col("rank")).drop("c_topic", "c_key", "c_batch", "before")
