"""Claims of a stream by history: late repeats, hot ids, expiry, and equality with the rule told row by row."""
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import raw_frame
from sluice.operators import route as R
from sluice.plans import triage as TR
from sluice.streaming import claims as CL
from sluice.streaming import jobs as J
from test_round2 import ENV

H = 3600
US = 1_000_000


def told(batches, ttl):
    """Rows (id, t, i, ok) of each batch in turn, one by one."""
    claims, out = {}, {}
    for rows in batches:
        for k, t, i, ok in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            mine = claims.setdefault(k, [])
            if t is not None and any(abs(t - s) < ttl for s in mine):
                out[i] = "duplicate"
            else:
                out[i] = "claimed"
                if ok and t is not None:
                    mine.append(t)
    return out


def skewed(n, seed, span=400):
    draw = np.random.default_rng(seed)
    return [(f"e{0 if draw.random() < 0.34 else draw.integers(1, 40)}", None if draw.random() < 0.02 else int(draw.integers(span)) * H,
             i, bool(draw.random() < 0.6)) for i in range(n)]


class State:
    """What ``applyInPandasWithState`` hands to the call."""
    def __init__(self):
        self.value, self.hasTimedOut, self.now, self.due = None, False, 0, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, v):
        self.value = v

    def remove(self):
        self.value = None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms


def test_open_windows_against_the_rule():
    draw = np.random.default_rng(1)
    for _ in range(300):
        held = sorted(set(draw.integers(0, 400, draw.integers(0, 4)).tolist()))
        times = np.unique(draw.integers(0, 400, draw.integers(0, 30)))
        mine = list(held)
        for t in times.tolist():
            if not any(abs(t - s) < 48 for s in mine):
                mine.append(t)
        assert CL.open_windows(held, times, 48) == mine[len(held):]


def test_batches_against_the_rule(spark):
    """Three batches, the last of late rows, one id with a third of them: packed by task, judged by join."""
    rows = skewed(900, 3)
    parts = [rows[:300], rows[300:600], rows[600:]]
    call, states, got = CL.claim_state(48 * H, 10 ** 9), {}, {}
    for part in parts:
        df = spark.createDataFrame([(k, t, i, ok, "x", 0, i) for k, t, i, ok in part], "event_id string, t long, i long, ok boolean, topic string, partition int, offset long") \
            .withColumn("clock", F.timestamp_seconds("t")).repartition(4)
        packed = df.where("clock IS NOT NULL").select("event_id", F.unix_micros("clock").alias("clock_us"), "ok").mapInArrow(CL.pack_times, CL.PACKED)
        assert packed.groupBy("event_id").count().agg(F.max("count")).first()[0] <= 4
        windows = []
        for k, group in packed.toPandas().groupby("event_id"):
            windows += [(k, list(map(int, r.held)), list(map(int, r.opened))) for out in call((k,), iter([group]), states.setdefault(k, State())) for r in out.itertuples()]
        judged = CL.judge(df, spark.createDataFrame(windows, CL.WINDOWS), 48 * H)
        got.update({r.i: r.dedup_status for r in judged.collect()})
    assert got == told(parts, 48 * H)


def test_pack_times_keeps_every_id():
    batch = pa.record_batch({"event_id": ["a", "b", "a", "a"], "clock_us": [3, 1, 3, 2], "ok": [True, False, True, True]})
    assert [x for b in CL.pack_times([batch]) for x in b.to_pylist()] == [{"event_id": "a", "times": [2, 3]}, {"event_id": "b", "times": []}]
    assert list(CL.pack_times([])) == []


def test_windows_leave_the_state_by_the_clock():
    call, state = CL.claim_state(48 * H, 100), State()
    feed = lambda t: next(iter(call(("a",), iter([pd.DataFrame({"times": [[t * H * US]]})]), state)))
    feed(0)
    state.now = 60_000
    assert feed(100).opened[0] == [100 * H * US] and state.due == 100_000
    state.now, state.hasTimedOut = 100_000, True
    assert list(call(("a",), iter([]), state)) == [] and list(state.value[0]) == [100 * H * US] and state.due == 160_000
    state.now = 160_000
    assert list(call(("a",), iter([]), state)) == [] and state.value is None


@pytest.mark.parametrize("fault", [False, True])
def test_repeat_that_is_days_late_is_handled(spark, tmp_path, fault):
    """Claims at hour 0 and 100, then rows of the id at hours 30, 60 and 101, and one 200 hours before the first."""
    def at(o, h):
        return ("visits", 0, o, ENV % "a", f"{pd.Timestamp('2024-03-01') + pd.Timedelta(hours=h)}")
    first, second = raw_frame(spark, [at(0, 0), at(1, 100)]), raw_frame(spark, [at(2, 30), at(3, 60), at(4, 101), at(5, -200), at(6, -199)])
    first, second = (x.withColumn("fault", F.when(F.col("offset").isin(0, 5), F.lit("error")) if fault else F.lit(None).cast("string")) for x in (first, second))
    out = J.triage_replay(spark, [first, second], R.registry_frame(spark), R.topics_frame(spark), fault_col="fault", out=str(tmp_path / "out"))
    got = {r.offset: r.outcome for r in out.collect()}
    # 60 is within 48 h of the claim at 100; with a failure at 0 the row at 30 is the first that succeeds there
    assert got == ({0: "retry", 1: "processed", 2: "processed", 3: "duplicate", 4: "duplicate", 5: "retry", 6: "processed"} if fault else
                   {0: "processed", 1: "processed", 2: "duplicate", 3: "duplicate", 4: "duplicate", 5: "processed", 6: "duplicate"})


def test_late_by_more_than_a_window_equals_batch(spark):
    rows = [("cases", 0, i, ENV % f"e{i % 3}", f"2024-03-{d:02d} {i % 5:02d}:00:00") for i, d in enumerate([20, 20, 20, 21, 21, 21, 10, 10, 10, 11, 11, 11])]
    raw = raw_frame(spark, rows)
    out = J.triage_replay(spark, [raw.where("offset < 6"), raw.where("offset >= 6")], R.registry_frame(spark), R.topics_frame(spark))
    want = TR.run_triage(raw, R.registry_frame(spark), R.topics_frame(spark))
    assert sorted(map(tuple, out.select("offset", "outcome").collect())) == sorted(map(tuple, want.select("offset", "outcome").collect()))


def test_hot_id_is_not_one_task(spark):
    """A third of a micro-batch has one id: with small thresholds the join to its windows is split."""
    raw = raw_frame(spark, [("cases", 0, i, ENV % ("hot" if i % 3 else f"e{i}"), f"2024-03-01 {i % 24:02d}:00:00") for i in range(3000)])
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        path = J.scratch(spark, "rows")
        raw.select(F.when(F.col("offset") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("e"), "offset")).alias("event_id"), F.col("timestamp").alias("clock"), F.lit(True).alias("ok"),
                   "topic", "partition", "offset", F.repeat(F.lit("x"), 50).alias("wide")).repartition(8).write.parquet(path)
        rows = spark.read.parquet(path)
        windows = spark.createDataFrame([("hot", [], [1709251200000000])] + [(f"e{i}", [], []) for i in range(0, 3000, 3)], CL.WINDOWS)
        judged = CL.judge(rows, windows)
        judged.collect()
        assert "skew=true" in judged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
