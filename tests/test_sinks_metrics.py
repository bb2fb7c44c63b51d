"""Batches committed once, whatever is killed and replayed; hot keys by sketch and exact second pass."""
import collections
import glob
import os

import numpy as np
import pytest

from sluice.operators.metrics import hot_keys
from sluice.sources import sinks as SK
from sluice.streaming.jobs import scratch


def rows(spark, n, start=0):
    return spark.createDataFrame([("a.dlq" if i % 2 else "b.retry", f"k{i}", f"v{i}") for i in range(start, start + n)], "sink_topic string, sink_key string, sink_value string")


def test_killed_and_replayed_batches_count_once(spark, monkeypatch):
    path = scratch(spark, "sink")
    SK.write_records(rows(spark, 10), path=path, batch_id=0)
    step = SK.on_path

    def killed(s, p, action):
        if "_commits/" in p:
            raise RuntimeError("killed before the commit")
        return step(s, p, action)
    monkeypatch.setattr(SK, "on_path", killed)
    with pytest.raises(RuntimeError):
        SK.write_records(rows(spark, 7, 100), path=path, batch_id=1)
    monkeypatch.setattr(SK, "on_path", step)
    assert SK.read_committed(spark, path).count() == 10 and len(glob.glob(f"{path}/data/attempt=1-*")) == 1
    for _ in range(2):  # the replay, and a second one of a batch that is committed
        SK.write_records(rows(spark, 7, 100), path=path, batch_id=1)
    got = SK.read_committed(spark, path)
    assert sorted(r.sink_value for r in got.collect()) == sorted(f"v{i}" for i in [*range(10), *range(100, 107)])
    assert {r.batch: r["count"] for r in got.groupBy("batch").count().collect()} == {0: 10, 1: 7}
    assert len(glob.glob(f"{path}/data/attempt=1-*")) == 1 and sorted(SK.committed(spark, path)) == [0, 1]


def test_half_written_attempt_is_not_read(spark):
    path = scratch(spark, "half")
    assert SK.read_committed(spark, path, "sink_key string").count() == 0
    rows(spark, 3).write.partitionBy("sink_topic").parquet(f"{path}/data/attempt=5-dead")  # killed while it wrote
    SK.write_records(rows(spark, 4), path=path, batch_id=6)
    assert SK.read_committed(spark, path).count() == 4
    SK.write_records(rows(spark, 3), path=path, batch_id=5)
    assert SK.read_committed(spark, path).count() == 7 and not os.path.exists(f"{path}/data/attempt=5-dead")


@pytest.mark.parametrize("tracked", [16, 64, 4096])
def test_hot_keys_are_exact(spark, tracked):
    """A clear top, a flat group that no sketch can rank, ties, a small group, null keys."""
    draw = np.random.default_rng(4)
    keys = [("clear", f"k{min(int(x), 400)}") for x in draw.zipf(1.4, 4000)] + [("flat", f"f{i % 1500}") for i in range(3000)] + [("ties", f"t{i % 40:02d}") for i in range(400)] \
        + [("small", x) for x in ("a", "b", "b")] + [("null", None)] * 5
    got = hot_keys(spark.createDataFrame(keys, "topic string, affinity_key string").repartition(4), k=5, tracked=tracked).collect()
    want = set()
    for g in {g for g, k in keys}:
        c = collections.Counter(k for t, k in keys if t == g and k is not None)
        want |= {(g, k, n, i + 1) for i, (k, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert {(r.topic, r.affinity_key, r.n, r["rank"]) for r in got} == want and len(got) == len(want)
