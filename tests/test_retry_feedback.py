"""A republish that fails leaves again after its delay, by way of the schedule's second input; the others leave once."""
import collections
import os
import time

from pyspark.sql import functions as F

from conftest import raw_frame
from sluice.sources.sinks import write_republished
from sluice.streaming import jobs as J
from test_pipeline import _retry_env


def test_failed_republish_leaves_again(spark):
    past = '"2024-01-01T00:00:30Z"'
    raw = raw_frame(spark, [("cases.retry", 0, i, _retry_env(f"e{i}", past, i + 1), "2024-01-01 00:00:00") for i in range(6)])
    src, out = J.scratch(spark, "fb-src"), J.scratch(spark, "fb-out")
    raw.coalesce(1).write.parquet(src)
    tries, sent = collections.defaultdict(list), []

    def send(records, batch_id):
        """e1 fails once, e4 twice; what is delivered is written."""
        r = records.select("event_id", "sink_topic", "sink_key", "sink_value").collect()
        now, result = time.time(), []
        for x in r:
            tries[x.event_id].append(now)
            good = len(tries[x.event_id]) > {"e1": 1, "e4": 2}.get(x.event_id, 0)
            result.append((x.event_id, good))
            if good:
                sent.append((x.event_id, x.sink_topic, x.sink_value))
        write_republished(records.where(F.col("event_id").isin([e for e, g in result if g])), path=os.path.join(out, "sent"), batch_id=batch_id)
        return records.sparkSession.createDataFrame(result, "event_id string, delivered boolean")
    q = J.start_retry_scheduler(spark.readStream.schema(raw.schema).parquet(src), out, out + "-ckpt", trigger={"processingTime": "1 second"}, send=send, delay_s=4)
    try:
        end = time.time() + 120
        while time.time() < end and len(sent) < 6:
            assert q.exception() is None
            time.sleep(0.5)
        time.sleep(3)
    finally:
        q.stop()
    assert sorted(e for e, _, _ in sent) == [f"e{i}" for i in range(6)]
    assert {e: len(t) for e, t in tries.items()} == {"e0": 1, "e1": 2, "e2": 1, "e3": 1, "e4": 3, "e5": 1}
    assert all(b - a >= 4 for t in tries.values() for a, b in zip(t, t[1:]))
    assert {e: v for e, _, v in sent}["e4"].count('"retryCount":5') == 1 and {t for _, t, _ in sent} == {"cases"}


def test_feedback_survives_a_restart(spark):
    """Stopped after the failure was written: the next run on the checkpoint sends the record, and no other again."""
    past = '"2024-01-01T00:00:30Z"'
    raw = raw_frame(spark, [("cases.retry", 0, i, _retry_env(f"e{i}", past, 1), "2024-01-01 00:00:00") for i in range(3)])
    src, out = J.scratch(spark, "fr-src"), J.scratch(spark, "fr-out")
    raw.coalesce(1).write.parquet(src)
    tries = collections.Counter()

    def send(records, batch_id):
        ids = [r.event_id for r in records.select("event_id").collect()]
        tries.update(ids)
        return records.sparkSession.createDataFrame([(e, tries[e] > (e == "e2")) for e in ids], "event_id string, delivered boolean")

    def run():
        J.start_retry_scheduler(spark.readStream.schema(raw.schema).parquet(src), out, out + "-ckpt", send=send, delay_s=0).awaitTermination()
    run()
    assert tries == {"e0": 1, "e1": 1, "e2": 1}
    for _ in range(3):
        time.sleep(1)
        run()
    assert tries == {"e0": 1, "e1": 1, "e2": 2}
