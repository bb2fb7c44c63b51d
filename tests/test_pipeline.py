"""Whole-chain properties on the sf0.001 message log, the stream = batch check and oracle spot checks."""
import duckdb
import pytest

from sluice.operators import route as R
from sluice.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_every_record_has_one_outcome(spark):
    from sluice.plans import triage as TR
    m = Q._messages(spark, SF)
    t = TR.triage_log(m, R.registry_frame(spark), R.topics_frame(spark), fault_col="fault")
    assert t.count() == m.count()
    assert t.where("outcome is null").count() == 0
    assert t.groupBy("topic", "partition", "offset").count().where("count > 1").count() == 0


def test_register_handler(spark):
    from sluice.operators import handlers as H
    reg = H.register_handler({}, "VISIT_APPROVED", 1, H.DEFAULT_HANDLERS["VISIT_APPROVED"])
    reg = H.register_handler(reg, "VISIT_APPROVED", 2, H.Handler("visit_v2", H.visit_approved))
    with pytest.raises(ValueError):
        H.register_handler(reg, "VISIT_APPROVED", 1, H.DEFAULT_HANDLERS["VISIT_APPROVED"])
    frame, by_name = H.registry_of(spark, reg)
    rows = sorted((r["event_type"], r["version"], r["processor"]) for r in frame.collect())
    assert rows == [("VISIT_APPROVED", 1, "VISIT_APPROVED"), ("VISIT_APPROVED", 2, "visit_v2")]
    assert set(by_name) == {"VISIT_APPROVED", "visit_v2"}


def test_registry_duplicates_raise(spark):
    reg = spark.createDataFrame([("A", 1, "p"), ("A", 1, "q")], R.REGISTRY_DDL)
    with pytest.raises(ValueError):
        R.check_registry_unique(reg)
    R.check_registry_unique(R.registry_frame(spark))


@pytest.mark.parametrize("name", ["validate_envelope", "classify_outcome", "write_retry", "write_dlq",
                                  "due_retries", "committable_offsets", "processing_duration", "lane_load",
                                  "run_triage_two_runs", "dedup_within_watermark", "write_republished", "read_messages"])
def test_oracle_spot(spark, name):
    import __spark_entry__ as E
    from tools_compare import rows
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    a = rows(E.queries()[name](spark, SF).toPandas())
    b = rows(con.sql(E.oracle_sql()[name]).df())
    assert a == b


def test_stream_equals_batch(spark):
    from conftest import raw_frame

    from sluice.streaming.jobs import triage_replay
    from test_parse import env
    rows = [("cases", 0, i, env(eventId=f'"e{i % 3}"'), f"2024-01-0{1 + i // 4} 0{i % 4}:00:00")
            for i in range(10)]
    raw = raw_frame(spark, rows)
    from pyspark.sql import functions as F
    out = triage_replay(spark, [raw.where("offset < 5"), raw.where(F.col("offset") >= 5)], R.registry_frame(spark), R.topics_frame(spark))
    from sluice.plans import triage as TR
    batch = TR.run_triage(raw, R.registry_frame(spark), R.topics_frame(spark))
    cols = ["topic", "partition", "offset", "outcome"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def _retry_env(eid, due, n):
    return ('{"version":1,"eventId":"%s","eventType":"VISIT_APPROVED","tenantId":"t1",'
            '"timestamp":"2024-01-01T00:00:00Z","data":{},"originalTopic":"cases","retryCount":%d,'
            '"failureReason":"boom","firstFailureTime":"2024-01-01T00:00:00Z",'
            '"lastFailureTime":"2024-01-01T00:00:00Z","nextRetryAfter":%s}' % (eid, n, due))


def test_retry_scheduler_stream_releases_due_once(spark):
    import os

    from conftest import raw_frame

    from sluice.sources.sinks import write_records
    from sluice.streaming.jobs import scratch, start_retry_scheduler

    past, far = '"2024-01-01T00:00:30Z"', '"2999-01-01T00:00:00Z"'
    first = [("cases.retry", 0, 0, _retry_env("e1", far, 1), "2024-01-01 00:00:00"),
             ("cases.retry", 0, 1, _retry_env("e2", past, 2), "2024-01-01 00:00:00"),
             ("cases.retry", 0, 2, _retry_env("e4", past, 1), "2024-01-01 00:00:00"),
             ("cases.retry", 0, 3, _retry_env("e4", far, 2), "2024-01-01 00:00:05"),    # replaces the entry due
             ("cases.retry", 0, 4, "not json", "2024-01-01 00:00:06")]
    later = [("cases.retry", 0, 5, _retry_env("e1", past, 2), "2024-01-01 00:00:10"),   # replaces e1
             ("cases.retry", 0, 6, _retry_env("e3", past, 1), "2023-01-01 00:00:00")]   # a year late
    src, out = scratch(spark, "retry-src"), scratch(spark, "retry-out")
    for rows in (first, later):
        raw = raw_frame(spark, rows)
        raw.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src)
    start_retry_scheduler(stream, out, out + "-ckpt").awaitTermination()
    from sluice.sources.sinks import read_committed
    got = read_committed(spark, os.path.join(out, "republished")).collect()
    assert sorted(r["sink_value"].split('"eventId":"')[1][:2] for r in got) == ["e1", "e2", "e3"]
    e1 = [r for r in got if '"eventId":"e1"' in r["sink_value"]][0]
    assert '"retryCount":2' in e1["sink_value"] and e1["sink_topic"] == "cases"
    recs = read_committed(spark, os.path.join(out, "republished")).select("sink_value", "sink_topic", "sink_key")
    write_records(recs, path=os.path.join(out, "sink"), batch_id=0)
    write_records(recs, path=os.path.join(out, "sink"), batch_id=0)
    assert read_committed(spark, os.path.join(out, "sink")).count() == 3


def test_quiet_topic_releases_and_expires_by_the_clock(spark):
    """No record follows: the entry due in some seconds is still released, the one without a due time expires."""
    import os
    import time
    from datetime import datetime, timedelta, timezone

    from conftest import raw_frame

    from sluice.sources.sinks import read_committed
    from sluice.streaming.jobs import scratch, start_retry_scheduler
    soon = (datetime.now(timezone.utc) + timedelta(seconds=8)).strftime('"%Y-%m-%dT%H:%M:%SZ"')
    raw = raw_frame(spark, [("cases.retry", 0, 0, _retry_env("e1", soon, 1), "2024-01-01 00:00:00"),
                            ("cases.retry", 0, 1, _retry_env("e2", "null", 1), "2024-01-01 00:00:00")])
    src, out = scratch(spark, "quiet-src"), scratch(spark, "quiet-out")
    raw.coalesce(1).write.parquet(src)
    q = start_retry_scheduler(spark.readStream.schema(raw.schema).parquet(src), out, out + "-ckpt",
                              trigger={"processingTime": "1 second"}, ttl_s=10)

    def rows(kind):
        return read_committed(spark, os.path.join(out, kind), "sink_value string, event_id string").collect()
    try:
        end = time.time() + 90
        while time.time() < end and not (rows("republished") and rows("expired")):
            assert q.exception() is None
            time.sleep(1)
    finally:
        q.stop()
    assert ['"eventId":"e1"' in r["sink_value"] for r in rows("republished")] == [True]
    assert [r["event_id"] for r in rows("expired")] == ["e2"]


def spark_lit(v):
    from pyspark.sql import functions as F
    return F.lit(v)


def test_metric_inclusion_rules(spark):
    """Duplicates count as received only; a panic counts as panic and processing_error; raw dead
    letters are not in the dead-letter counter; unknown types are not received."""
    from pyspark.sql import functions as F

    from conftest import raw_frame
    from sluice.operators import metrics as M
    from sluice.plans import triage as TR
    from test_parse import env

    rows = [("cases", 0, 0, env(eventId='"e1"'), "2024-01-01 00:00:00"),
            ("cases", 0, 1, env(eventId='"e1"'), "2024-01-01 01:00:00"),      # duplicate inside 48 h
            ("cases", 0, 2, "not json", "2024-01-01 02:00:00"),                # raw dead letter
            ("cases", 0, 3, env(eventId='"e4"', eventType='"CASE_ASSIGNED"'), "2024-01-01 03:00:00"),
            ("cases", 0, 4, env(eventId='"e5"'), "2024-01-01 04:00:00"),      # panics -> retry
            ("cases", 0, 5, env(eventId='"e6"', data="5"), "2024-01-01 05:00:00")]  # business error
    raw = raw_frame(spark, rows).withColumns({
        "fault": F.when(F.col("offset") == 4, F.lit("panic")),
        "duration_s": F.lit(0.02)})
    t = TR.run_triage(raw, R.registry_frame(spark), R.topics_frame(spark), fault_col="fault")
    outcomes = {r["offset"]: r["outcome"] for r in t.collect()}
    assert outcomes == {0: "processed", 1: "duplicate", 2: "dlq", 3: "dlq", 4: "retry", 5: "dlq"}

    def total(df, **where):
        return sum(r["n"] for r in df.collect() if all(r[k] == v for k, v in where.items()))
    assert total(M.messages_received(t)) == 4
    assert total(M.messages_processed(t)) == 1
    assert total(M.messages_failed(t), reason="panic") == 1
    assert total(M.messages_failed(t), reason="processing_error") == 2
    assert total(M.messages_retried(t)) == 1
    assert total(M.messages_dlq(t)) == 2
    inf = [r for r in M.processing_duration(t).collect() if r["le"] == "+Inf"]
    assert sum(r["bucket_count"] for r in inf) == 3


def test_stream_restart_from_checkpoint(spark):
    """Stop after half the log, add the rest, restart on the same checkpoint: no loss, no repeat,
    and claims made before the restart still mark later copies as duplicates."""
    import os

    from pyspark.sql import functions as F

    from conftest import raw_frame
    from sluice.plans import triage as TR
    from sluice.streaming.jobs import scratch, start_triage_stream
    from test_parse import env
    rows = [("cases", 0, i, env(eventId=f'"e{i % 4}"'), f"2024-01-0{1 + i // 6} {i % 6:02d}:00:00")
            for i in range(12)]
    raw = raw_frame(spark, rows)
    src, out = scratch(spark, "restart-src"), scratch(spark, "restart-out")
    ckpt = out + "-ckpt"
    first, second = raw.where(F.col("offset") < 6), raw.where(F.col("offset") >= 6)
    first.write.mode("append").parquet(src)
    reg, tops = R.registry_frame(spark), R.topics_frame(spark)
    start_triage_stream(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src),
                        reg, tops, out, ckpt).awaitTermination()
    second.write.mode("append").parquet(src)
    start_triage_stream(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src),
                        reg, tops, out, ckpt).awaitTermination()
    from sluice.sources.sinks import read_committed
    got = read_committed(spark, os.path.join(out, "outcomes")).select("offset", "outcome").collect()
    want = TR.run_triage(raw, reg, tops).select("offset", "outcome").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len(got) == 12 and sum(1 for r in got if r["outcome"] == "duplicate") > 0


def test_frontier_never_passes_an_open_offset(spark):
    import random

    from sluice.operators import progress as PR
    rnd = random.Random(5)
    rows = []
    for p in range(6):
        start = rnd.randrange(0, 50)
        offs = sorted(rnd.sample(range(start, start + 80), 40))
        rows += [("t", p, o, rnd.random() < 0.9) for o in offs]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, completed boolean")
    front = {r["partition"]: r["committable"] for r in PR.committable_offsets(df).collect()}
    for p in range(6):
        mine = sorted((o, c) for t, q, o, c in rows if q == p)
        first_open = next((o for o, c in mine if not c), None)
        if first_open is None:
            assert front[p] == mine[-1][0]
        elif first_open == mine[0][0]:
            assert p not in front
        else:
            assert front[p] < first_open and all(c for o, c in mine if o <= front[p])


def test_read_messages_and_split(spark):
    import os

    from conftest import raw_frame
    from sluice.sources.messages import read_messages, split_retry_topics, with_path
    from sluice.streaming.jobs import scratch
    rows = [("cases", 0, 0, "{}", "2024-01-01 00:00:00"), ("cases.retry", 1, 0, "{}", "2024-01-01 00:00:01")]
    path = os.path.join(scratch(spark, "raw"), "log")
    raw_frame(spark, rows).write.parquet(path)
    log = read_messages(spark, path=path, stream=False)
    assert [f.name for f in log.schema.fields] == ["topic", "partition", "offset", "key", "value", "timestamp"]
    main, retry = split_retry_topics(log)
    assert main.count() == 1 and retry.count() == 1
    assert sorted(r["path"] for r in with_path(log).collect()) == ["process", "schedule"]


def test_lookup_falls_back_to_shuffle_join_above_bound(spark):
    reg = R.registry_frame(spark)
    big = R.bounded_broadcast(reg, max_rows=1)    # 2 rows > 1: no broadcast hint
    small = R.bounded_broadcast(reg, max_rows=10)
    ev = spark.createDataFrame([("VISIT_APPROVED", 1), ("X", 1)], "event_type string, version long")
    for r in (big, small):
        got = ev.join(r.select("event_type", "version", "processor"), ["event_type", "version"], "left")
        assert sorted((x["event_type"], x["processor"]) for x in got.collect()) == \
            [("VISIT_APPROVED", "VISIT_APPROVED"), ("X", None)]
