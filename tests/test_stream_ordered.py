"""The ordering buffer: every key's events in arrival order across micro-batches, against plain Python."""
import random

import pytest
from pyspark.sql import functions as F

from sluice.sources.sinks import committed
from sluice.streaming import jobs as J
from sluice.streaming import ordered as OR

COLS = "topic string, partition int, offset bigint, affinity_key string, clock timestamp, v string"


def frame(spark, rows):
    """rows: (topic, partition, offset, key, second or None, v)."""
    df = spark.createDataFrame(rows, COLS.replace("clock timestamp", "s bigint"))
    return df.select("topic", "partition", "offset", "affinity_key", F.timestamp_seconds("s").alias("clock"), "v")


def log(n=400, seed=1):
    """A third of all rows share a key; two partitions."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        key = "hot" if i % 3 == 0 else draw.choice(["a", "b", None, "c"])
        rows.append(("t", i % 2, i // 2, key, 1000 + i // 4, draw.choice(["x", "y"])))
    return rows


def make_step(calls=None):
    def step(state, row):  # local, so that it is sent to the workers by value
        if calls is not None:
            calls.add(1)
        if row["v"] == "bad":
            raise ValueError("bad row")
        return (state or "") + row["v"], state
    return step


step = make_step()


def expected(batches, wait):
    """Plain Python: (batch, key, rows in order) and the late rows."""
    held, front, out, late = [], None, [], set()
    for new in [*batches, None]:
        have = held + (new or [])
        clocks = [r[4] for r in have if r[4] is not None]
        to = max([x for x in [front, max(clocks) - wait if clocks and new is not None else None] if x is not None], default=None)
        go = have if new is None else [r for r in have if r[4] is None or r[4] <= to]
        late |= {r[1:3] for r in go if r[4] is None or (front is not None and r[4] <= front)}
        held = [r for r in have if r not in go]
        out += sorted(go, key=lambda r: (r[4] is not None, r[4] or 0, r[1], r[2]))
        front = to
    return out, late


def run(spark, batches, wait, step=step):
    out = J.scratch(spark, "ordered-test")
    for n, b in enumerate(batches):
        OR.order_batch(frame(spark, b), out, n, wait, step=step)
    OR.finish_ordered(spark, out, frame(spark, []).schema, step=step)
    return out


def check(spark, out, batches, wait):
    want, late = expected(batches, wait)
    got = OR.read_ordered(spark, out, handled=True).orderBy("seq").collect()
    assert len(got) == len(want) == sum(len(b) for b in batches)
    for key in {r[3] for r in want}:
        mine = [r for r in want if r[3] == key]
        have = [r for r in got if r["affinity_key"] == key]
        assert [(r["partition"], r["offset"]) for r in have] == [r[1:3] for r in mine]
        assert [r["seq"] for r in have] == list(range(1, len(mine) + 1))
        state = None
        for r, h in zip(mine, have):
            if r[5] == "bad":
                assert h["error"] == "ValueError: bad row" and h["output"] is None
                continue
            assert h["output"] == state and h["error"] is None
            state = (state or "") + r[5]
    ordered = {(r["partition"], r["offset"]) for r in OR.read_ordered(spark, out).where("late").collect()}
    assert ordered == late


def test_keys_in_order_though_partitions_drift(spark):
    rows = log()
    ahead = [[r for r in rows if a <= r[4] + 10 * r[1] < b] for a, b in ((0, 1030), (1030, 1060), (1060, 10 ** 6))]
    calls = spark.sparkContext.accumulator(0)
    out = run(spark, ahead, 20, make_step(calls))
    assert calls.value == len(rows)
    check(spark, out, ahead, 20)
    assert not OR.read_ordered(spark, out).where("late").count()


def test_late_rows_rows_without_clock_and_failures(spark):
    rows = log(120, 5)
    late = [("t", 7, 0, "hot", 1001, "x"), ("t", 7, 1, "a", None, "y"), ("t", 7, 2, "hot", 1020, "bad"), ("t", 7, 3, "hot", 1029, "y")]
    batches = [rows[:80], [], [*rows[80:], *late], [("t", 7, 4, None, 2000, "x")]]
    check(spark, run(spark, batches, 5), batches, 5)


def test_states_survive_compaction(spark, monkeypatch):
    monkeypatch.setattr(OR, "COMPACT", 2)
    rows = log(100, 9)
    batches = [rows[i:i + 20] for i in range(0, 100, 20)]
    check(spark, run(spark, batches, 1), batches, 1)


def test_a_killed_batch_counts_once(spark, monkeypatch):
    """A batch that stops before its frontier is committed is computed again; nothing is released or handled twice."""
    rows = log(90, 3)
    batches = [rows[:30], rows[30:60], rows[60:]]
    real = OR.commit_batch

    def fail(df, path, n, *a):
        if path.endswith(("held", "handled")) and n == 1 and not failed.get(path):
            failed[path] = True
            raise RuntimeError("killed")
        return real(df, path, n, *a)
    out, failed = J.scratch(spark, "ordered-test"), {}
    monkeypatch.setattr(OR, "commit_batch", fail)
    for n, b in enumerate(batches):
        for _ in range(3):
            try:
                OR.order_batch(frame(spark, b), out, n, 2, step=step)
            except RuntimeError:
                pass
    OR.finish_ordered(spark, out, frame(spark, []).schema, step=step)
    assert len(failed) == 2 and sorted(committed(spark, out + "/frontier")) == [0, 1, 2, 3]
    check(spark, out, batches, 2)


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="rank"):
        OR.order_batch(frame(spark, []).withColumn("Rank", F.lit(1)), J.scratch(spark, "ordered-test"), 0, 1)


def test_finished_log_does_not_start_again(spark):
    out = J.scratch(spark, "ordered-test")
    src = out + "-src"
    frame(spark, log(20)).write.parquet(src)
    rows = spark.readStream.schema(frame(spark, []).schema).parquet(src)
    OR.start_ordered_stream(rows, out, out + "-ckpt", wait_s=3).awaitTermination()
    OR.finish_ordered(spark, out, rows.schema)
    assert OR.read_ordered(spark, out).count() == 20
    with pytest.raises(ValueError, match="finished"):
        OR.start_ordered_stream(rows, out, out + "-ckpt")
