from pyspark.sql import functions as F

from sluice.operators import progress as PR
from sluice.operators import retry as RT


def _sched(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, due_s long, scheduled_at string")
    return df.withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp"))


def test_due_order_and_zero_time(spark):
    s = _sched(spark, [("b", 100, "2024-01-01"), ("a", 100, "2024-01-01"), ("z", -62135596800, "2024-01-01"),
                       ("c", 50, "2024-01-01"), ("late", 10**12, "2024-01-01"), ("gone", 1, "2023-12-31")])
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert sorted(r["event_id"] for r in RT.due_retries(s, now).collect()) == ["a", "b", "c"]
    assert [r["event_id"] for r in RT.due_retries(s, now, limit=2).collect()] == ["c", "a"]


def test_release_once_and_expiry(spark):
    """Due and a day old: lost, not released. Scheduled anew after its release: it leaves again."""
    s = _sched(spark, [("a", 1, "2024-01-02 10:00:00"), ("b", 2, "2024-01-02 10:00:00"), ("old", 3, "2024-01-01"), ("c", 10**11, "2024-01-05"), ("new", 4, "2024-01-02 12:00:00")])
    released = _sched(spark, [("a", 1, "2024-01-02 10:00:00"), ("new", 2, "2024-01-02 01:00:00")])
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert sorted(r["event_id"] for r in RT.release_due_once(s, released, now).collect()) == ["b", "new"]
    assert [r["event_id"] for r in RT.expire_schedules(s, released, now).collect()] == ["old"]


def _simulate(rows, now, ticks, ttl):
    """A table of schedules told second by second: the entry of an id is replaced, released by a tick, or its payload expires."""
    out, entry = {}, {}
    for s in range(0, now + 1):
        for k, i, at, due in rows:
            if at == s:
                if k in entry:
                    out[entry[k][0]] = ("replaced", s)
                entry[k] = (i, at, due)
        for k, (i, at, due) in list(entry.items()):
            if at + ttl == s:
                out[i] = ("expired", s)
                del entry[k]
            elif due is not None and due <= s and (ticks is None or s in ticks):
                out[i] = ("released", s)
                del entry[k]
    out.update({i: ("pending", None) for i, _, _ in entry.values()})
    return out


def test_timeline_against_seconds(spark):
    """Every schedule ends once; one id has a third of them."""
    import random
    rnd = random.Random(8)
    at = rnd.sample(range(400), 240)
    rows = [(f"e{0 if rnd.random() < 0.34 else rnd.randrange(1, 30)}", i, a, None if rnd.random() < 0.1 else a + rnd.choice([-500, 0, 5, 30, 90])) for i, a in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id string, offset long, at long, due long").select(
        "event_id", F.lit("t.retry").alias("topic"), F.lit(0).alias("partition"), "offset", F.timestamp_seconds("at").alias("timestamp"), F.lit(None).cast("string").alias("retry_error"),
        F.col("due").isNull().alias("next_retry_zero"), F.timestamp_seconds("due").alias("next_retry_after"))
    for now, ticks in ((500, None), (300, None), (350, [100, 200, 250, 300]), (500, [10, 450])):
        got = {r.offset: (r.end, None if r.ended_at is None else int(r.e)) for r in RT.retry_timeline(
            df, F.timestamp_seconds(F.lit(now)), None if ticks is None else [F.timestamp_seconds(F.lit(t)) for t in ticks], ttl_s=60).withColumn("e", F.unix_seconds("ended_at")).collect()}
        rows_ = [r for r in rows if r[2] <= now]
        # a due time before 1970 (negative) is the zero time's kind: never reached
        want = _simulate([(k, i, a, d if d is not None and d >= 0 else None) for k, i, a, d in rows_], now, ticks, 60)
        assert got == want
    assert RT.retry_timeline(df.limit(0), F.timestamp_seconds(F.lit(1))).count() == 0


def _prog(spark, rows):
    return spark.createDataFrame(rows, "topic string, partition int, offset long, completed boolean")


def test_frontier_lenient_and_strict(spark):
    rows = [("t", 0, o, c) for o, c in [(5, True), (6, True), (8, True), (9, False), (10, True)]]
    rows += [("t", 1, 0, False), ("t", 1, 1, True)]
    rows += [("t", 2, 3, True), ("t", 2, 4, True)]
    p = _prog(spark, rows)
    lenient = {(r["partition"]): r["committable"] for r in PR.committable_offsets(p).collect()}
    strict = {(r["partition"]): r["committable"] for r in PR.committable_offsets_strict(p).collect()}
    assert lenient == {0: 8, 2: 4}  # partition 1: first offset still open -> nothing
    assert strict == {0: 6, 2: 4}   # the hole at 7 stops the strict frontier
    lag = {r["partition"]: r["lag"] for r in PR.consumer_lag(p).collect()}
    assert lag == {0: 2, 1: 2, 2: 0}
    inf = {r["partition"]: r["in_flight"] for r in PR.in_flight(p).collect()}
    assert inf == {0: 1, 1: 1, 2: 0}


def test_schedule_latest_wins(spark):
    from conftest import raw_frame

    from sluice.operators.parse import parse_retry_envelope

    def env(n, due):
        return ('{"eventId":"e1","originalTopic":"cases","retryCount":%d,"nextRetryAfter":"%s"}' % (n, due))
    rows = [("cases.retry", 0, 0, env(1, "2024-01-01T00:00:30Z"), "2024-01-01 00:00:00"),
            ("cases.retry", 0, 1, env(2, "2024-01-01T00:01:30Z"), "2024-01-01 00:00:30"),
            ("cases.retry", 0, 2, '{"eventId":"e2","originalTopic":"cases"}', "2024-01-01 00:00:30")]
    parsed = parse_retry_envelope(raw_frame(spark, rows))
    s = {r["event_id"]: r for r in RT.with_payload(RT.schedule_retries(parsed), parsed).collect()}
    assert s["e1"]["retry_count"] == 2 and s["e1"]["due_s"] == 1704067290
    assert s["e2"]["due_s"] == -62135596800  # absent nextRetryAfter: never due
