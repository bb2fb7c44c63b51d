"""Nothing is cut, dropped or silently unhandled."""
import os

import pytest
from pyspark.sql import functions as F

from conftest import raw_frame
from sluice.functions.clock import parse_rfc3339
from sluice.operators import handlers as H
from sluice.operators import retry as RT
from sluice.operators import route as R
from sluice.plans import triage as TR
from sluice.sources.sinks import read_committed
from sluice.streaming import jobs as J

ENV = '{"version":1,"eventId":"%s","eventType":"VISIT_APPROVED","tenantId":"t","timestamp":"2024-01-01T00:00:00Z","data":{"visitId":"v"}}'


def test_ticks_add_up_to_no_limit(spark):
    s = spark.createDataFrame([(f"e{i}", i // 3) for i in range(1200)], "event_id string, due_s long").withColumn("scheduled_at", F.lit("1970-01-01").cast("timestamp"))
    now = F.lit("1970-01-01 01:00:00").cast("timestamp")
    whole = {r.event_id for r in RT.due_retries(s, now).collect()}
    seen = s.limit(0)
    got = []
    while True:
        tick = [r.event_id for r in RT.release_due_once(s, seen, now, limit=500).collect()]
        if not tick:
            break
        got += tick
        seen = s.where(F.col("event_id").isin(got))
    assert len(got) == len(set(got)) and set(got) == whole and len(whole) == 1200


def test_rfc3339_end_and_comma(spark):
    rows = [("2024-01-02T00:00:00Z\n",), ("2024-01-02T00:00:00,5Z",), ("2024-01-02T00:00:00.5Z",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(F.unix_micros(parse_rfc3339(F.col("s")))).collect()]
    assert got[0] is None and got[1] == got[2] is not None


def test_wiring_errors_raise(spark):
    raw = raw_frame(spark, [("visits", 0, 0, ENV % "a", "2024-01-01 00:00:00")])
    twice = spark.createDataFrame([("VISIT_APPROVED", 1, "visit-approved"), ("VISIT_APPROVED", 1, "x")], "event_type string, version int, processor string")
    lone = spark.createDataFrame([("VISIT_APPROVED", 1, "nobody")], "event_type string, version int, processor string")
    with pytest.raises(ValueError, match="duplicate"):
        TR.prepare(raw, twice, R.topics_frame(spark))
    with pytest.raises(ValueError, match="nobody"):
        TR.prepare(raw, lone, R.topics_frame(spark))
    H.check_handlers(R.registry_frame(spark))


def test_stream_gives_every_record_an_outcome(spark, tmp_path):
    first = raw_frame(spark, [("visits", 0, 0, ENV % "a", "2024-03-01 00:00:00"), ("visits", 0, 1, (ENV % "b").replace("2024-01-01T", "2999-01-01T"), "2024-03-02 00:00:00")])
    late = raw_frame(spark, [("visits", 0, 2, ENV % "c", "2024-01-01 00:00:00"), ("visits", 0, 3, ENV % "a", "2024-03-01 01:00:00"),
                             ("visits.retry", 0, 0, "not json", "2024-03-02 00:00:00")])
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part in (first, late):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(src)
    J.start_triage_stream(stream, R.registry_frame(spark), R.topics_frame(spark), out, str(tmp_path / "ck")).awaitTermination()
    got = {(r.topic, r.offset): r.outcome for r in read_committed(spark, os.path.join(out, "outcomes")).collect()}
    assert got == {("visits", 0): "processed", ("visits", 1): "processed", ("visits", 2): "processed", ("visits", 3): "duplicate", ("visits.retry", 0): "dlq"}
    sinks = read_committed(spark, os.path.join(out, "sinks")).collect()
    assert [r.sink_topic for r in sinks] == ["visits.retry.dlq"]


def test_python_handler_sees_its_own_rows_only(spark, tmp_path):
    """Another type, an unknown type and a bad record never reach the function."""
    seen = str(tmp_path / "seen")

    def visit(row):
        with open(seen, "a") as f:
            f.write(row["event_id"] + "\n")
    hs = {"VISIT_APPROVED": H.Handler("VISIT_APPROVED", H.python_handler(visit, ["event_id"])),
          "NOTIFICATION_TRIGGERED": H.DEFAULT_HANDLERS["NOTIFICATION_TRIGGERED"]}
    env = [ENV % "a", (ENV % "b").replace("VISIT_APPROVED", "NOTIFICATION_TRIGGERED"),
           (ENV % "c").replace("VISIT_APPROVED", "CASE_ASSIGNED"), "not json"]
    raw = raw_frame(spark, [("visits", 0, i, e, "2024-01-01 00:00:00") for i, e in enumerate(env)]
                    + [("refunds", 0, 0, ENV % "d", "2024-01-01 00:00:00")])
    got = TR.run_triage(raw, R.registry_frame(spark), R.topics_frame(spark), handlers=hs)
    assert {r.offset: r.outcome for r in got.where("topic = 'visits'").collect()} == {0: "processed", 1: "processed", 2: "dlq", 3: "dlq"}
    assert open(seen).read().split() == ["a"]
