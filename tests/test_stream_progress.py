"""Frontiers from batches in any order, and counters of a stream, against the whole-table operators."""
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from sluice.operators import metrics as M
from sluice.operators import progress as PR
from sluice.operators import route as R
from sluice.plans import queries as Q
from sluice.plans import triage as TR
from sluice.streaming import frontier as FR
from sluice.streaming import jobs as J
from test_stream_claims import State

SF = "/root/testdata/sf0.001"


def as_set(s):
    return {x for lo, hi in zip(*s) for x in range(lo, hi + 1)}


def test_interval_sets_against_sets():
    draw = np.random.default_rng(2)
    for _ in range(300):
        a, b = ({int(x) for x in draw.integers(0, 40, draw.integers(0, 30))} for _ in range(2))
        sets = []
        for s in (a, b):
            x = np.array(sorted(s, key=lambda _: draw.random()), np.int64)
            u = FR.union(x, x)
            assert as_set(u) == s and all(u[0][1:] > u[1][:-1] + 1)
            sets.append(u)
        assert FR.overlap(*sets) == len(a & b) and FR.size(sets[0]) == len(a)
        assert FR.first_open(*sets) == min(a - b, default=None)


def test_batches_in_any_order_give_the_whole_table_answer(spark):
    """Tracking and completions shuffled over batches, some twice; a hole; the state stays as small as its gaps."""
    rnd = random.Random(3)
    rows = [("a/b", 1, o, rnd.random() < 0.9) for o in range(100, 400) if o != 180] + [("t", 0, o, True) for o in range(50)] + [("u", 0, o, False) for o in (5, 6)]
    events = [(t, p, o, False) for t, p, o, _ in rows] + [(t, p, o, True) for t, p, o, c in rows if c]
    events += rnd.sample(events, 60)
    rnd.shuffle(events)
    states, last = {}, {}
    for at in range(0, len(events), 90):
        part = events[at: at + 90]
        batches = [pa.record_batch({n: [r[i] for r in x] for i, n in enumerate(("topic", "partition", "offset", "completed"))}) for x in (part[:50], part[50:]) if x]
        packed = pa.Table.from_batches(list(FR.pack_intervals(batches))).to_pandas()
        for key, group in packed.groupby(["topic", "partition"]):
            for out in FR.advance(key, iter([group]), states.setdefault(key, State())):
                last[key] = out.iloc[0]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, completed boolean")
    none = lambda x: None if pd.isna(x) else int(x)
    assert {k: none(v.committable) for k, v in last.items() if none(v.committable) is not None} == {(r.topic, r.partition): r.committable for r in PR.committable_offsets(df).collect()}
    assert {k: none(v.committable_strict) for k, v in last.items() if none(v.committable_strict) is not None} == {(r.topic, r.partition): r.committable for r in PR.committable_offsets_strict(df).collect()}
    assert {k: (none(v.tracked), none(v.in_flight)) for k, v in last.items()} == {(r.topic, r.partition): (r.tracked, r.in_flight) for r in PR.in_flight(df).collect()}
    assert {k: none(v.lag) for k, v in last.items()} == {(r.topic, r.partition): r.lag for r in PR.consumer_lag(df).collect()}
    open_ = sum(not c for _, _, _, c in rows)
    assert sum(v.intervals for v in last.values()) <= open_ + 2 * len(last) + 2 and last["t", 0].intervals == 2


def test_a_frontier_moves_once(spark):
    state, got = State(), []
    for offsets, done in (([0, 1, 2], [False] * 3), ([1, 2], [True, True]), ([0], [True]), ([0], [True])):
        packed = next(FR.pack_intervals([pa.record_batch({"topic": ["t"] * len(offsets), "partition": [0] * len(offsets), "offset": offsets, "completed": done})])).to_pandas()
        got.append([bool(r.moved) for out in FR.advance(("t", 0), iter([packed]), state) for r in out.itertuples()][0])
    assert got == [False, False, True, False]


def test_counters_of_a_replay_equal_the_batch_tables(spark):
    m, reg, tops = Q._messages(spark, SF), R.registry_frame(spark), R.topics_frame(spark)
    t = TR.run_triage(m, reg, tops, fault_col="fault")
    out = J.scratch(spark, "counted")
    cut = m.selectExpr("percentile(unix_micros(timestamp), 0.5)").first()[0]
    J.triage_replay(spark, [m.where(f"unix_micros(timestamp) <= {cut}"), m.where(f"unix_micros(timestamp) > {cut}")], reg, tops, fault_col="fault", out=out, duration_col="duration_s")
    c = J.read_counters(spark, out)

    def of(name, *cols):
        return sorted(map(tuple, c.where(c.metric == name).select(*cols, "n").collect()), key=str)
    labels = ["topic", "event_type", "tenant_id"]
    table = lambda f: sorted(map(tuple, f(t).collect()), key=str)
    assert of("messages_received", "topic", "tenant_id") == table(M.messages_received)
    for name in ("messages_processed", "messages_retried", "messages_dlq"):
        assert of(name, *labels) == table(getattr(M, name))
    assert of("messages_failed", *labels, "label") == table(M.messages_failed)
    assert sorted(map(tuple, M.histogram(c).collect()), key=str) == table(M.processing_duration)
    assert c.where("metric = 'messages_received'").count() > 10
