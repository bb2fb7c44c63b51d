"""The cost of a record in the batch triage: compiled methods, one parse a record, a name's member by position."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.functions.hashing import fnv1a32
from sluice.operators import parse as P
from sluice.operators import retry as RT
from sluice.sources import fixtures

T0 = dt.datetime(2024, 1, 1)
GOOD = ('{"version":1,"eventId":"e1","eventType":"A","tenantId":"t","timestamp":"2024-01-01T00:00:00Z",'
        '"originalTopic":"cases","retryCount":2,"nextRetryAfter":"2024-01-01T00:00:30Z"}')


def raw(spark, texts):
    rows = [("cases.retry", 0, i, None, bytearray(t.encode()), T0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "topic STRING, partition INT, offset LONG, key BINARY, value BINARY, timestamp TIMESTAMP")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generated_methods_stay_short_enough_to_be_compiled(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    P.parse_envelope(raw(spark, [GOOD]))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


@pytest.mark.parametrize("text, error, version, event_id", [
    ('{"version":1,"eventId":"a"}', None, 1, "a"),
    ('{"VERSION":2,"eventID":"b"}', None, 2, "b"),
    ('{"version":1,"eventId":"a","EVENTID":"b"}', None, 1, "b"),
    ('{"version":1,"eventId":"a","eventId":null}', None, 1, "a"),
    ('{"version":null,"eventId":null}', None, 0, ""),
    ('{"version":1,"eventId":5,"eventId":"a"}', "number into Go struct field rawEnvelope.eventId", 0, ""),
    ('{"eventId":true,"version":"1"}', "bool into Go struct field rawEnvelope.eventId", 0, ""),
    ('{"version":"1","eventId":true}', "string into Go struct field rawEnvelope.version", 0, ""),
    ('{"version":1.5,"other":{"eventId":3}}', "number 1.5 into Go struct field rawEnvelope.version", 0, ""),
    ("{}", None, 0, ""), ("null", None, 0, ""), ("[1]", "array into Go value", 0, ""), ("{} x", "malformed JSON", 0, ""),
])
def test_members_by_position_and_where_names_repeat(spark, text, error, version, event_id):
    r = P.parse_envelope(raw(spark, [text])).select("decode_error", "version", "event_id").first()
    assert (r.decode_error is None) if error is None else (error in r.decode_error)
    assert (r.version, r.event_id) == (version, event_id)


def test_hash_of_every_byte_without_a_number_parse_a_byte(spark):
    def fnv(k):
        h = 2166136261
        for b in k.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h
    keys = ["", "t1:c5", "\x00", "é日本😀", "a\nb\r", "\x7f\x80ÿ", "x" * 500]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "k STRING").select("k", fnv1a32(F.col("k")).alias("h"))
    assert {r.k: r.h for r in df.collect()} == {**{k: fnv(k) for k in keys}, None: None}
    assert "conv(" not in plan(df)


def test_timeline_ranks_written_rows(spark, monkeypatch):
    seen = []

    def ranks(df, *a, **kw):
        seen.append(plan(df))
        return rank_within(df, *a, **kw)
    rank_within = RT.rank_within
    monkeypatch.setattr(RT, "rank_within", ranks)
    late = GOOD.replace("00:00:30Z", "00:99:30Z")
    rows = RT.retry_timeline(P.parse_retry_envelope(raw(spark, [GOOD, late, GOOD])), F.lit(T0 + dt.timedelta(hours=1))).collect()
    assert sorted((r.seq, r.end) for r in rows) == [(1, "replaced"), (2, "released")]
    assert len(seen) == 1 and "from_json" not in seen[0].lower() and "jsontostructs" not in seen[0].lower()


def test_retry_log_ranks_written_rows(spark, monkeypatch):
    seen = []
    rank_within = fixtures.rank_within
    monkeypatch.setattr(fixtures, "rank_within", lambda df, *a, **kw: (seen.append(plan(df)), rank_within(df, *a, **kw))[1])
    ev = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), i % 7, "error", 1.0, '{"k":1}') for i in range(1, 60)],
                               "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING")
    from sluice.operators import route as R
    from sluice.plans.triage import run_triage
    m = fixtures.messages_from_events(ev)
    t = run_triage(m, R.registry_frame(spark), R.topics_frame(spark), fault_col="fault")
    log = fixtures.retry_log(t, m)
    assert log.count() == t.where("outcome = 'retry'").count() + m.where("topic = 'payments' AND source_id % 11 = 0").count() > 0
    assert "from_json" not in seen[-1].lower() and "to_json" not in seen[-1].lower()
