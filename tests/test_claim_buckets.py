"""The state holds many ids a call: one call a group and micro-batch, the same windows an id."""
import pandas as pd

from sluice.streaming import claims as CL
from sluice.streaming.jobs import _start
from test_stream_claims import H, State, US, skewed


def _feed(call, state, rows):
    return {r.event_id: (list(r.held), list(r.opened)) for out in call((0,), iter([pd.DataFrame(rows, columns=["event_id", "times"])]), state) for r in out.itertuples()}


def test_group_gives_each_id_what_a_call_of_its_own_gives():
    rows, states = skewed(900, 5), {}
    one, every, group = CL.claim_state(48 * H, 10 ** 9), CL.bucket_state(48 * H, 10 ** 9), State()
    for part in (rows[:300], rows[300:600], rows[600:]):
        packed = [(k, sorted({t * US for i, t, _, ok in half if i == k and ok and t is not None})) for half in (part[::2], part[1::2]) for k in sorted({r[0] for r in half})]
        got, want = _feed(every, group, packed), {}
        for k in sorted({k for k, _ in packed}):
            out = next(iter(one((k,), iter([pd.DataFrame({"times": [x for i, x in packed if i == k]})]), states.setdefault(k, State()))))
            want[k] = (list(map(int, out.held[0])), list(map(int, out.opened[0])))
        assert got == want


def test_claims_of_a_group_leave_one_by_one():
    call, state = CL.bucket_state(48 * H, 100), State()
    assert _feed(call, state, [("a", [0]), ("b", [])]) == {"a": ([], [0]), "b": ([], [])}
    state.now = 60_000
    assert _feed(call, state, [("c", [5])]) == {"c": ([], [5])} and state.due == 100_000
    state.now, state.hasTimedOut = 100_000, True
    assert list(call((0,), iter([]), state)) == [] and list(state.value[0]) == ["c"]
    state.now = 160_000
    assert list(call((0,), iter([]), state)) == [] and state.value is None


def test_stream_of_many_ids_in_two_groups(spark, tmp_path):
    """Fifty ids in two groups of the state: a row for each."""
    spark.createDataFrame([(f"e{i}", i) for i in range(50)], "event_id string, t long").selectExpr("event_id", "timestamp_seconds(t) AS clock", "true AS ok").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id string, clock timestamp, ok boolean").parquet(str(tmp_path / "in"))
    rows = []
    out = CL.claim_windows(stream, buckets=2).writeStream.foreachBatch(lambda df, n: rows.extend(df.collect()))
    assert _start(out.option("checkpointLocation", str(tmp_path / "ck")), None, spark).awaitTermination(120)
    assert sorted((r.event_id, r.held, r.opened) for r in rows) == sorted((f"e{i}", [], [i * US]) for i in range(50))
