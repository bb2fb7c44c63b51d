"""Claims of a stream: a history of windows per event id, and rows judged against it.

The state call sees no message. Ids are kept in ``BUCKETS`` groups by their hash, one call a group and micro-batch, as a call an id
costs a hundred times what it does. Per id it gets the times of successful runs, packed
by task (``pack_times``), and returns the windows that its history holds and those the batch adds
(``claim_windows``); the rows themselves are joined to these windows afterwards (``judge``). So an id that holds a
third of a batch is eight bytes a row in one state call, and its rows stay split over tasks.

Rule, for a row with time t and windows [s, s + ttl):

* a window made in an earlier batch makes every row with s - ttl < t < s + ttl a duplicate: in order of time, the row
  and the claim's row would have been in one window, and one of them has run already;
* inside a batch, rows count in order of (clock, topic, partition, offset): the first successful one that no window holds
  opens a window, what follows in it is a duplicate, a failed run leaves no window.

A row that is ``ttl`` or more away from every claim, however late, is claimed. Windows leave the
state ``keep_s`` of processing time after they were made, as a key with a time to live does.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from sluice import constants as K
from sluice.operators.dedup import CLAIMED, DUPLICATE

POSITION = ["topic", "partition", "offset"]
LONGS = T.ArrayType(T.LongType())
PACKED = "event_id string, times array<bigint>"
WINDOWS = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("held", LONGS), T.StructField("opened", LONGS)])
HISTORY = T.StructType([T.StructField("start_us", LONGS), T.StructField("made_ms", LONGS)])
BUCKET_HISTORY = T.StructType([T.StructField("event_id", T.ArrayType(T.StringType())), *HISTORY.fields])
PACK_ROWS = 1 << 20
#: Groups of the state. A group holds the ids that have a claim now and hash to it, and is written anew when one of them comes: raise it with the ids
#: alive at a time. A checkpoint keeps the number it began with.
BUCKETS = 1 << 14


def pack_times(batches):
    """(event id, clock in microseconds, ok) -> one row an id and task: the distinct times of its successful runs."""
    import pyarrow as pa

    def packed(tables):
        t = pa.Table.from_batches(tables).combine_chunks()
        ids = t.column("event_id").combine_chunks().dictionary_encode()
        code, clock = ids.indices.to_numpy(), t.column("clock_us").to_numpy()
        ok = t.column("ok").to_numpy(zero_copy_only=False).astype(bool)
        pairs = np.unique(np.rec.fromarrays([code[ok], clock[ok]], names="c,t"))
        ends = np.searchsorted(pairs["c"], np.arange(len(ids.dictionary) + 1))
        times = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs["t"], pa.int64()))
        return pa.RecordBatch.from_arrays([ids.dictionary.cast(pa.string()), times], names=["event_id", "times"])
    held, n = [], 0
    for b in batches:
        held, n = held + [b], n + b.num_rows
        if n >= PACK_ROWS:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def open_windows(held: Sequence[int], times: np.ndarray, ttl_us: int) -> list[int]:
    """Starts of the windows that successful runs at ``times`` (ascending) open beside those ``held`` from before."""
    held, opened, i = np.sort(np.asarray(held, np.int64)), [], 0
    while i < len(times):
        t = int(times[i])
        at = int(np.searchsorted(held, t - ttl_us, "right"))  # the first claim later than t - ttl
        if at < len(held) and held[at] < t + ttl_us:
            i = int(np.searchsorted(times, held[at] + ttl_us))
        else:
            opened.append(t)
            i = int(np.searchsorted(times, t + ttl_us))
    return opened


def claim_state(ttl_s: int, keep_s: int):
    """The state call of ``applyInPandasWithState``: history in, windows of this batch out."""
    ttl_us, keep_ms = ttl_s * 1_000_000, keep_s * 1000

    def call(key, pdfs, state):
        now = state.getCurrentProcessingTimeMs()
        starts, made = (list(x) for x in state.get) if state.exists else ([], [])
        left = [(s, m) for s, m in zip(starts, made) if m + keep_ms > now]
        starts, opened = [s for s, _ in left], []
        if not state.hasTimedOut:
            times = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for pdf in pdfs for x in pdf["times"]]]))
            opened = open_windows(starts, times, ttl_us)
        left += [(s, now) for s in opened]
        if left:
            state.update(([s for s, _ in left], [m for _, m in left]))
            state.setTimeoutDuration(max(1, min(m for _, m in left) + keep_ms - now))
        elif state.exists:
            state.remove()
        if not state.hasTimedOut:
            yield pd.DataFrame({"event_id": [key[0]], "held": [starts], "opened": [opened]})
    return call


def bucket_state(ttl_s: int, keep_s: int):
    """``claim_state`` for all ids of a group in one call; what it returns for an id is the same."""
    ttl_us, keep_ms = ttl_s * 1_000_000, keep_s * 1000

    def call(key, pdfs, state):
        now, timed_out = state.getCurrentProcessingTimeMs(), state.hasTimedOut
        left = [x for x in zip(*state.get) if x[2] + keep_ms > now] if state.exists else []
        held: dict[str, list[int]] = {}
        for i, s, _ in left:
            held.setdefault(i, []).append(s)
        times: dict[str, list] = {}
        if not timed_out:
            for pdf in pdfs:
                for i, x in zip(pdf["event_id"], pdf["times"]):
                    times.setdefault(i, []).append(x)
        out = []
        for i, parts in times.items():
            starts = held.get(i, [])
            if not starts and len(parts) == 1 and len(parts[0]) < 2:
                opened = [int(t) for t in parts[0]]
            else:
                opened = open_windows(starts, np.unique(np.concatenate([np.asarray(x, np.int64) for x in parts])), ttl_us)
            out.append((i, starts, opened))
            left += [(i, s, now) for s in opened]
        if left:
            state.update(tuple(list(x) for x in zip(*left)))
            state.setTimeoutDuration(max(1, min(m for _, _, m in left) + keep_ms - now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=WINDOWS.names)
    return call


def claim_windows(rows: DataFrame, ttl_s: int = K.DEDUP_TTL_S, keep_s: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Stream of (event_id, clock, ok) -> (event_id, held, opened): one row an id and micro-batch."""
    narrow = rows.where("event_id IS NOT NULL AND clock IS NOT NULL").select("event_id", F.unix_micros("clock").alias("clock_us"), "ok")
    packed = narrow.mapInArrow(pack_times, PACKED).withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int"))
    return packed.groupBy("bucket").applyInPandasWithState(
        bucket_state(ttl_s, ttl_s if keep_s is None else keep_s), outputStructType=WINDOWS, stateStructType=BUCKET_HISTORY,
        outputMode="append", timeoutConf=GroupStateTimeout.ProcessingTimeTimeout)


def judge(rows: DataFrame, windows: DataFrame, ttl_s: int = K.DEDUP_TTL_S, ok: str = "ok", out: str = "dedup_status") -> DataFrame:
    """Rows of one micro-batch with their status. ``windows`` has one row an id, so AQE can split a hot id's rows.

    Which of several rows with a window's start is its claim is settled by position, with one small aggregate.
    """
    t, ttl = F.unix_micros("clock"), F.lit(ttl_s * 1_000_000)
    marked = rows.join(windows.select("event_id", "held", "opened"), "event_id", "left")
    owner = marked.where(F.col(ok) & F.array_contains("opened", t)).groupBy("event_id", t.alias("_t")).agg(F.min(F.struct(*POSITION)).alias("_own"))
    marked = marked.withColumn("_t", t).join(owner, ["event_id", "_t"], "left")
    old = F.exists("held", lambda s: F.abs(F.col("_t") - s) < ttl)
    new = F.exists("opened", lambda s: (F.col("_t") > s) & (F.col("_t") < s + ttl))
    after = F.struct(*POSITION) > F.col("_own")
    again = F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)) | F.coalesce(after, F.lit(False))
    return marked.withColumn(out, F.when(again, F.lit(DUPLICATE)).otherwise(F.lit(CLAIMED))).drop("held", "opened", "_t", "_own")
