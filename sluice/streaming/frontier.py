"""Commit frontiers that advance from batch to batch.

A partition's state is two sets of offsets, tracked and completed, each as sorted intervals without
gaps between neighbours. Sets merge in any order and any number of times, so records may complete late, twice, or before
they are tracked. What is contiguous is one interval: the state is as large as the number of gaps, which the records in flight
bound, not the log. Frontiers, records in flight and lag are read off the two sets.

A task packs its rows to intervals per partition before the shuffle (``pack_intervals``), so a partition with a third of all
records reaches its state call as a few arrays.
"""
from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from sluice.operators.progress import TP
from sluice.sources.sinks import commit_batch

LONGS = T.ArrayType(T.LongType())
SETS = ["tracked_lo", "tracked_hi", "done_lo", "done_hi"]
PACKED = "topic string, partition int, " + ", ".join(f"{c} array<bigint>" for c in SETS)
STATE = T.StructType([T.StructField(c, LONGS) for c in SETS] + [T.StructField("committable", T.LongType())])
FRONTIER = T.StructType([T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType())]
                        + [T.StructField(c, T.LongType()) for c in ("first_offset", "last_offset", "committable", "committable_strict", "tracked", "in_flight", "lag")]
                        + [T.StructField("moved", T.BooleanType()), T.StructField("intervals", T.IntegerType())])

Intervals = tuple[np.ndarray, np.ndarray]


def union(lo: np.ndarray, hi: np.ndarray) -> Intervals:
    """The same offsets as sorted intervals (both ends included) that neither meet nor touch."""
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = np.asarray(lo, np.int64)[order], np.maximum.accumulate(np.asarray(hi, np.int64)[order])
    start = np.concatenate(([True], lo[1:] > hi[:-1] + 1))
    at = np.flatnonzero(start)
    return lo[at], hi[np.concatenate((at[1:] - 1, [len(hi) - 1]))]


def size(s: Intervals) -> int:
    return int((s[1] - s[0] + 1).sum())


def overlap(a: Intervals, b: Intervals) -> int:
    """How many offsets both hold."""
    both = union(np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])))
    return size(a) + size(b) - size(both)


def first_open(tracked: Intervals, done: Intervals) -> int | None:
    """The smallest offset that is tracked and not completed."""
    for lo, hi in zip(*tracked):
        at = int(np.searchsorted(done[0], lo, "right")) - 1
        x = int(lo) if at < 0 or done[1][at] < lo else int(done[1][at]) + 1
        if x <= hi:
            return x
    return None


def frontier(tracked: Intervals, done: Intervals) -> dict:
    """first and last offset, lenient and strict frontier (None: nothing to commit), records tracked and in flight, lag."""
    if not len(tracked[0]):
        return dict.fromkeys(("first_offset", "last_offset", "committable", "committable_strict"), None) | {"tracked": 0, "in_flight": 0, "lag": 0}
    first, last = int(tracked[0][0]), int(tracked[1][-1])
    open_ = first_open(tracked, done)
    lenient = last if open_ is None else open_ - 1
    at = int(np.searchsorted(done[0], first, "right")) - 1
    strict = min(int(done[1][at]), last) if at >= 0 and done[1][at] >= first else None
    n = size(tracked)
    lenient = lenient if lenient >= first else None
    return {"first_offset": first, "last_offset": last, "committable": lenient, "committable_strict": strict, "tracked": n,
            "in_flight": n - overlap(tracked, done), "lag": last - (first - 1 if lenient is None else lenient)}


def pack_intervals(batches):
    """(topic, partition, offset, completed) -> one row a task and partition: its offsets as intervals."""
    import pyarrow as pa
    held: dict = {}
    for b in batches:
        offsets, done = b.column("offset").to_numpy(), b.column("completed").to_numpy(zero_copy_only=False).astype(bool)
        keys = np.asarray([f"{p}/{t}" for t, p in zip(b.column("topic").to_pylist(), b.column("partition").to_pylist())], dtype=object)
        names, code = np.unique(keys, return_inverse=True)
        for i, name in enumerate(names):
            o, d = offsets[code == i], done[code == i]
            was = held.get(name, (np.zeros(0, np.int64),) * 4)
            held[name] = (*union(np.concatenate((was[0], o)), np.concatenate((was[1], o))),
                          *union(np.concatenate((was[2], o[d])), np.concatenate((was[3], o[d]))))
    if held:
        split = [k.split("/", 1) for k in held]
        yield pa.RecordBatch.from_arrays([pa.array([t for _, t in split]), pa.array([int(p) for p, _ in split], pa.int32()),
                                          *[pa.array([x[i].tolist() for x in held.values()], pa.list_(pa.int64())) for i in range(4)]], names=["topic", "partition", *SETS])


def advance(key, pdfs, state):
    """The state call: the batch's intervals merged into the partition's."""
    was = [np.asarray(x, np.int64) for x in state.get[:4]] if state.exists else [np.zeros(0, np.int64)] * 4
    last = state.get[4] if state.exists else None
    parts = [was, *[[np.asarray(r[c], np.int64) for c in SETS] for pdf in pdfs for r in pdf[SETS].to_dict("records")]]
    tracked, done = (union(np.concatenate([p[i] for p in parts]), np.concatenate([p[i + 1] for p in parts])) for i in (0, 2))
    f = frontier(tracked, done)
    strict = f["committable_strict"]
    state.update((*[x.tolist() for x in (*tracked, *done)], strict if strict is not None else last))
    moved = strict is not None and (last is None or strict > last)
    out = pd.DataFrame([{"topic": key[0], "partition": key[1], **f, "moved": moved, "intervals": len(tracked[0]) + len(done[0])}])
    yield out.astype({x.name: "Int64" for x in FRONTIER.fields if isinstance(x.dataType, T.LongType)})


def frontier_stream(progress: DataFrame) -> DataFrame:
    """Stream of (topic, partition, offset, completed), a record's tracking and its completion alike -> the frontier of every
    partition that a batch touches. ``moved``: a strict frontier passed the last one, to be committed (strict, as a hole may be a record not yet seen)."""
    return progress.select(*TP, "offset", "completed").mapInArrow(pack_intervals, PACKED).groupBy(*TP).applyInPandasWithState(
        advance, outputStructType=FRONTIER, stateStructType=STATE, outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout)


def start_frontier_stream(progress: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None):
    """Write each batch's frontiers below ``out_dir/frontier``, committed by batch id; returns the ``StreamingQuery``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        commit_batch(batch, os.path.join(out_dir, "frontier"), batch_id)
    return (frontier_stream(progress).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
