"""Structured Streaming jobs.

* ``start_triage_stream``: raw records -> stateless prepare (parse, lookups,
  handler), written once -> per-event-id history of claims (``claims``) ->
  ``foreachBatch`` sink that judges the rows and writes outcomes and retry / dead-letter records,
  committed by batch id so that a replayed batch counts once.
* ``start_retry_scheduler``: ``.retry`` records -> per-event-id schedule state
  with a wall-clock timer at the due time -> republished envelopes, or a list of expired ones.
* ``watermark_dedup_replay``: Spark's built-in ``dropDuplicatesWithinWatermark``.

State lives in the state store (RocksDB provider set by ``get_spark``) and is
checkpointed with the offsets, so a lost executor or a restart resumes without
loss; sinks are keyed by batch id for idempotent replays.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sluice import constants as K
from sluice.operators import handlers as H
from sluice.operators import metrics as M
from sluice.operators import outcome as O
from sluice.operators.dedup import dedup_within_watermark
from sluice.operators.retry import ZERO_TIME_EPOCH_S, reschedule_failed
from sluice.plans import triage as TR
from sluice.session import checkpoint_dir, make_folder
from sluice.sources.sinks import commit_batch, read_committed, write_records, write_republished
from sluice.streaming import claims as CL

ORDER = ["clock", "topic", "partition", "offset"]

# columns carried through the stateful step (what the sinks and metrics need)
CARRY = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("key", T.BinaryType()),
    T.StructField("value_str", T.StringType()), T.StructField("clock", T.TimestampType()),
    T.StructField("version", T.LongType()), T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("tenant_id", T.StringType()),
    T.StructField("event_ts", T.TimestampType()), T.StructField("value_is_json", T.BooleanType()),
    T.StructField("retry_count", T.LongType()), T.StructField("first_failure_time", T.TimestampType()),
    T.StructField("envelope_error", T.StringType()), T.StructField("processor", T.StringType()),
    T.StructField("lanes", T.IntegerType()), T.StructField("affinity_key", T.StringType()),
    T.StructField("lane", T.LongType()), T.StructField("routed", T.BooleanType()),
    T.StructField("error_class", T.StringType()), T.StructField("error", T.StringType()),
])


def _plain(schema: T.StructType) -> T.StructType:
    """The schema in which rows pass through pandas: its timestamps end in 2262, an envelope's may not."""
    return T.StructType([T.StructField(f.name, T.LongType() if f.name == "clock" else T.StringType())
                         if isinstance(f.dataType, T.TimestampType) else f for f in schema.fields])


def _to_plain(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Clock as epoch microseconds, other times as their text (exact, NULL or not)."""
    return df.select(*[(F.unix_micros(f.name) if f.name == "clock" else F.unix_micros(f.name).cast("string")).alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in schema.fields])


def _from_plain(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.withColumns({f.name: F.timestamp_micros(F.col(f.name).cast("bigint"))
                           for f in schema.fields if isinstance(f.dataType, T.TimestampType)})


def prepare_stream(raw: DataFrame, registry: DataFrame, topics: DataFrame,
                   handlers: Mapping[str, H.Handler] | None = None, fault_col: str | None = None,
                   clock_col: str = "timestamp", duration_col: str | None = None) -> DataFrame:
    """Raw records with all that is known of them alone: parsed, looked up, handled. No state.

    ``duration_col`` of the input, if there is one, is the handler's time for the histogram.

    ``.retry`` records whose envelope does not decode come out here as dead letters (the scheduler job
    takes the others).
    """
    main = raw.where(~F.col("topic").endswith(K.RETRY_SUFFIX))
    v = TR.prepare(main, registry, topics, handlers, fault_col, clock_col).select(
        *[f.name for f in CARRY.fields], F.lit(None).cast("string").alias("retry_error"),
        (F.col(duration_col) if duration_col else F.lit(None)).cast("double").alias("duration_s"))
    bad = TR.triage_retry_topics(raw, clock_col).where(F.col("outcome") == K.DLQ)
    have = set(bad.columns)
    bad = bad.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in CARRY.fields], "retry_error", F.lit(None).cast("double").alias("duration_s"))
    return v.unionByName(bad)


PREPARED = T.StructType(CARRY.fields + [T.StructField("retry_error", T.StringType()), T.StructField("duration_s", T.DoubleType())])


def claimed_stream(prepared: DataFrame, ttl_s: int = K.DEDUP_TTL_S, keep_s: int | None = None) -> DataFrame:
    """Prepared rows, and beside them one row of ``windows`` for each id of the micro-batch (see ``claims``).

    The prepared table is read twice, once for the three columns that the state needs.
    """
    routed = F.coalesce(F.col("routed"), F.lit(False))
    windows = CL.claim_windows(prepared.where(routed).select("event_id", "clock", F.col("error").isNull().alias("ok")), ttl_s, keep_s)
    rows = prepared.select("*", F.lit(None).cast(CL.LONGS).alias("held"), F.lit(None).cast(CL.LONGS).alias("opened"))
    return rows.unionByName(windows, allowMissingColumns=True)


def outcomes(batch: DataFrame, ttl_s: int = K.DEDUP_TTL_S) -> DataFrame:
    """The outcome of every row of one micro-batch of ``claimed_stream``."""
    windows = batch.where("opened IS NOT NULL")
    rows = batch.where("opened IS NULL").drop("held", "opened").withColumn("ok", F.col("error").isNull())
    main, routed = F.col("retry_error").isNull(), F.coalesce(F.col("routed"), F.lit(False))
    judged = CL.judge(rows.where(main & routed), windows, ttl_s)
    others = rows.where(main & ~routed).withColumn("dedup_status", F.lit(None).cast("string"))
    done = O.classify_outcome(judged.unionByName(others))
    bad = TR.dead_letter_retries(rows.where(~main).withColumn("dedup_status", F.lit(None).cast("string")))
    return done.unionByName(bad.select(*done.columns)).drop("ok", "retry_error")


def _write_batch(out_dir: str, bootstrap: str | None = None, options: dict | None = None, ttl_s: int = K.DEDUP_TTL_S):
    def write(batch: DataFrame, batch_id: int) -> None:
        # the state calls and the prepared rows of the micro-batch, read more than once below
        batch.persist()
        done = outcomes(batch, ttl_s).persist()
        try:
            # each output is committed by batch id: a replayed batch counts once
            commit_batch(done.select(*TR.IDS, "event_id", "event_type", "tenant_id", "outcome", "reason", "sink_topic", "dedup_status"),
                         os.path.join(out_dir, "outcomes"), batch_id)
            write_records(TR.sink_records(done), path=os.path.join(out_dir, "sinks"), batch_id=batch_id,
                          bootstrap=bootstrap, options=options)
            commit_batch(M.counters(done), os.path.join(out_dir, "counters"), batch_id)
        finally:
            done.unpersist()
            batch.unpersist()
    return write


def _start(writer, trigger: dict | None, spark: SparkSession):
    """Start a stream whose state has processing-time timers.

    ``availableNow`` ends once its input is read, so batches without data are off for it (they would never
    stop); any other trigger keeps them, so that timers fire on a quiet topic.
    """
    trigger = trigger or {"availableNow": True}
    key, conf = "spark.sql.streaming.noDataMicroBatches.enabled", spark.conf
    was = conf.get(key, "true")
    conf.set(key, "false" if trigger.get("availableNow") else "true")
    try:
        return writer.trigger(**trigger).start()
    finally:
        conf.set(key, was)


@dataclass
class TriageJob:
    """The two queries of a triage stream, as one: ``prepare`` writes what ``claims`` reads."""
    prepare: StreamingQuery
    claims: StreamingQuery

    def awaitTermination(self, timeout: float | None = None) -> bool | None:
        return self.claims.awaitTermination(timeout) if timeout else self.claims.awaitTermination()

    def exception(self):
        return self.prepare.exception() or self.claims.exception()

    @property
    def isActive(self) -> bool:
        return self.prepare.isActive or self.claims.isActive

    def stop(self) -> None:
        self.prepare.stop()
        self.claims.stop()


def start_triage_stream(raw: DataFrame, registry: DataFrame, topics: DataFrame, out_dir: str,
                        checkpoint: str, handlers: Mapping[str, H.Handler] | None = None,
                        fault_col: str | None = None, trigger: dict | None = None,
                        bootstrap: str | None = None, options: dict | None = None,
                        ttl_s: int = K.DEDUP_TTL_S, keep_s: int | None = None, files_per_batch: int = 1000, duration_col: str | None = None) -> TriageJob:
    """Start the triage job: ``prepare`` parses, looks up and handles each record once and writes it below
    ``out_dir/prepared`` (Spark's file sink, each record once); ``claims`` reads that table, keeps the claims and writes outcomes.

    Records go to Kafka with ``bootstrap``, else to files below ``out_dir``; outcomes and counters always to files. With ``availableNow`` (the
    default) ``claims`` starts when ``prepare`` has ended; with any other trigger both run on.
    """
    spark, folder = raw.sparkSession, os.path.join(out_dir, "prepared")
    first = _start(prepare_stream(raw, registry, topics, handlers, fault_col, duration_col=duration_col).writeStream.format("parquet").option("path", folder)
                   .option("checkpointLocation", os.path.join(checkpoint, "prepare")), trigger, spark)
    if not trigger or trigger.get("availableNow"):
        first.awaitTermination()
    prepared = spark.readStream.schema(PREPARED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    second = _start(claimed_stream(prepared, ttl_s, keep_s).writeStream.foreachBatch(_write_batch(out_dir, bootstrap, options, ttl_s))
                    .option("checkpointLocation", os.path.join(checkpoint, "claims")), trigger, spark)
    return TriageJob(first, second)


# ------------------------------------------------------------ retry timers ---
ENTRY = T.StructType([
    T.StructField("due_ms", T.LongType()), T.StructField("scheduled_at", T.TimestampType()),
    T.StructField("original_topic", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("tenant_id", T.StringType()),
    T.StructField("event_ts", T.TimestampType()), T.StructField("data_json", T.StringType()),
    T.StructField("retry_count", T.LongType()), T.StructField("failure_reason", T.StringType()),
    T.StructField("first_failure_time", T.TimestampType())])
STORED = T.StructType(_plain(ENTRY).fields + [T.StructField("fires_ms", T.LongType())])
REPUBLISH = T.StructType([T.StructField("event_id", T.StringType())] + _plain(ENTRY).fields
                         + [T.StructField("expired", T.BooleanType())])
ZERO_TIME_MS = ZERO_TIME_EPOCH_S * 1000


class RetryScheduleProcessor(StatefulProcessor):
    """Latest schedule per event id, released once by the wall clock.

    One timer an entry: at its due time, or when its payload expires (``ttl_s`` after it was
    scheduled) if that comes first; a zero due time only expires. A due time in the past fires at once,
    however late the record is. Every entry leaves the state as released or as expired.
    """

    def __init__(self, ttl_s: int = K.RETRY_PAYLOAD_TTL_S):
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STORED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:  # one batch of rows at a time: only the latest is kept
            best = pdf.sort_values(ORDER, kind="stable").iloc[-1]
            if last is None or tuple(best[ORDER]) >= tuple(last[ORDER]):
                last = best
        if self.entry.exists():
            self.handle.deleteTimer(int(self.entry.get()[-1]))
        due_ms = int(last["due_ms"])
        ends = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms
        fires = due_ms if 0 <= due_ms < ends else ends
        self.entry.update(tuple([due_ms] + [None if pd.isna(last[f.name]) else last[f.name]
                                            for f in ENTRY.fields[1:]] + [fires]))
        self.handle.registerTimer(fires)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.entry.exists():
            return
        *e, fires = self.entry.get()
        self.entry.clear()
        yield pd.DataFrame([[key[0], *e, fires != e[0]]], columns=[f.name for f in REPUBLISH.fields])

    def close(self) -> None:
        pass


#: What the schedule's state reads of a record: its place in the order, its id and the entry.
SCHEDULED = T.StructType([T.StructField("clock", T.TimestampType()), T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
                          T.StructField("offset", T.LongType()), T.StructField("event_id", T.StringType()), *ENTRY.fields])


def _due_ms(due: str) -> Column:
    return F.coalesce(F.floor(F.unix_millis(due)).cast("bigint"), F.lit(ZERO_TIME_MS))


def retry_schedule_stream(raw: DataFrame, ttl_s: int = K.RETRY_PAYLOAD_TTL_S, again: DataFrame | None = None) -> DataFrame:
    """``.retry`` records -> entries leaving the schedule: due ones, and those whose payload ``expired``.

    ``again`` (``SCHEDULED`` columns) is a second input: entries whose republish failed. Bad envelopes are dead-lettered by
    the triage job.
    """
    from sluice.operators.parse import parse_retry_envelope
    r = parse_retry_envelope(raw.where(F.col("topic").endswith(K.RETRY_SUFFIX)))
    r = r.where(F.col("retry_error").isNull()).withColumns({
        "clock": F.col("timestamp"), "scheduled_at": F.col("timestamp"), "due_ms": _due_ms("next_retry_after")})
    rows = _to_plain(r, SCHEDULED)
    if again is not None:
        rows = rows.unionByName(_to_plain(again, SCHEDULED))
    # never NULL in any input: a batch in which one input is empty is planned without it, and the state's key must stay of one type
    rows = rows.withColumn("event_id", F.coalesce("event_id", F.lit("")))
    left = rows.groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=RetryScheduleProcessor(ttl_s), outputStructType=REPUBLISH,
        outputMode="Append", timeMode="ProcessingTime")
    return _from_plain(left, ENTRY)


Send = Callable[[DataFrame, int], DataFrame]


def start_retry_scheduler(raw: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None,
                          bootstrap: str | None = None, options: dict | None = None,
                          ttl_s: int = K.RETRY_PAYLOAD_TTL_S, send: Send | None = None, delay_s: int = K.REPUBLISH_FAILURE_DELAY_S):
    """Start the release job; returns the ``StreamingQuery``.

    Republished records go to Kafka with ``bootstrap``, else below ``out_dir/republished``; expired
    entries are listed below ``out_dir/expired``. With ``{"processingTime": "1 second"}`` every tick releases what is
    due by then; ``availableNow`` releases what is due when the input is read and leaves the rest in the checkpoint.
    A failed write fails the batch, which runs again from the checkpoint.

    A sink that knows the fate of each record is given as ``send(records, batch_id)``, returning (event_id, delivered). Records not
    delivered are written below ``out_dir/again`` with a due time ``delay_s`` from now; that folder is the second
    input of the schedule, so they leave again, and the others only once. A replayed batch writes its folder anew; an
    entry read twice replaces itself.
    """
    spark, folder = raw.sparkSession, os.path.join(out_dir, "again")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            due = batch.where("NOT expired")
            records = O.to_republish_envelope(due)
            if send is None:
                write_republished(records, batch_id=batch_id, path=os.path.join(out_dir, "republished"), bootstrap=bootstrap, options=options)
            else:
                lost = due.join(send(records, batch_id).where(~F.coalesce(F.col("delivered"), F.lit(False))).select("event_id").distinct(), "event_id")
                now = F.current_timestamp()
                lost = reschedule_failed(lost, F.lit(True), now, delay_s).withColumns({
                    "due_ms": _due_ms("next_retry_after"), "clock": now, "topic": F.col("original_topic"), "partition": F.lit(-1), "offset": F.lit(batch_id).cast("bigint")})
                lost = lost.select(*[F.col(f.name).cast(f.dataType) for f in SCHEDULED.fields]).persist()
                if not lost.isEmpty():
                    lost.write.mode("overwrite").parquet(os.path.join(folder, f"batch-{batch_id}"))
                lost.unpersist()
            commit_batch(batch.where("expired").select("event_id", "original_topic", "scheduled_at"), os.path.join(out_dir, "expired"), batch_id)
        finally:
            batch.unpersist()
    again = None
    if send is not None:
        make_folder(spark, folder)
        again = spark.readStream.schema(SCHEDULED).option("recursiveFileLookup", "true").parquet(folder)
    s = retry_schedule_stream(raw, ttl_s, again)
    return _start(s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger, spark)


# ------------------------------------------------------------------ replay ---
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def watermark_dedup_replay(spark: SparkSession, rows: DataFrame, key: str = "event_id", clock: str = "clock",
                           delay: str = "48 hours", slice_s: int = 7 * 24 * 3600) -> DataFrame:
    """``dropDuplicatesWithinWatermark`` over slices of ``slice_s`` seconds of log time, one micro-batch each.

    Each slice is appended and read to its end on the same checkpoint, so a batch is a slice whatever its
    number of files. Adds ``slice``, the number of the row's slice since the epoch.
    """
    src, out = scratch(spark, "wm-src"), scratch(spark, "wm-out")
    rows = rows.withColumn("slice", F.floor(F.unix_micros(clock) / F.lit(slice_s * 1_000_000)).cast("bigint"))
    # written once by slice: each slice is then a folder, not another pass over the source
    cut = scratch(spark, "wm-slices")
    rows.withColumn("of", F.col("slice")).write.partitionBy("of").parquet(cut)
    found = [r[0] for r in spark.read.parquet(cut).select("of").distinct().orderBy("of").collect()]
    if not found:
        return rows.limit(0)
    for n in found:
        spark.read.schema(rows.schema).parquet(f"{cut}/of={n}").write.mode("append").parquet(src)
        q = (dedup_within_watermark(spark.readStream.schema(rows.schema).parquet(src), clock, key, delay)
             .writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def triage_replay(spark: SparkSession, parts: Sequence[DataFrame], registry: DataFrame, topics: DataFrame,
                  fault_col: str | None = None, out: str | None = None, duration_col: str | None = None) -> DataFrame:
    """Run tables of raw records through the streaming job, one run to its end for each, on one checkpoint; returns the outcomes."""
    src, out = scratch(spark, "triage-src"), out or scratch(spark, "triage-out")
    for part in parts:
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        start_triage_stream(stream, registry, topics, out, out + "-ckpt", fault_col=fault_col, duration_col=duration_col).awaitTermination()
    return read_committed(spark, os.path.join(out, "outcomes"))


def read_counters(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counters of all batches that a triage job has written (see ``metrics.counters``)."""
    return M.merge_counters(read_committed(spark, os.path.join(out_dir, "counters")))
