"""One row per validation branch (first failing check wins), with the exact reason text."""
from pyspark.sql import functions as F

from conftest import raw_frame

from sluice.operators import parse as P

OK_TS = "2024-01-01T00:00:00Z"


def env(**kw):
    base = {"version": "1", "eventId": '"e1"', "eventType": '"VISIT_APPROVED"', "tenantId": '"t1"',
            "timestamp": f'"{OK_TS}"', "data": '{"caseId":"c1"}'}
    base.update(kw)
    return "{" + ",".join(f'"{k}":{v}' for k, v in base.items() if v is not None) + "}"


CASES = [
    (env(), None),
    ("not json", "invalid envelope: json unmarshal: malformed JSON"),
    (env() + " x", "invalid envelope: json unmarshal: malformed JSON"),
    ("", "invalid envelope: json unmarshal: unexpected end of JSON input"),
    ("[1]", "invalid envelope: json unmarshal: json: cannot unmarshal array into Go value of type event.rawEnvelope"),
    ("null", "invalid envelope: missing or zero version"),
    (env(version='"1"'), "invalid envelope: json unmarshal: json: cannot unmarshal string into Go struct field "
                         "rawEnvelope.version of type int"),
    (env(eventId="5"), "invalid envelope: json unmarshal: json: cannot unmarshal number into Go struct field "
                       "rawEnvelope.eventId of type string"),
    (env(version="0"), "invalid envelope: missing or zero version"),
    (env(version=None), "invalid envelope: missing or zero version"),
    (env(eventId=None), "invalid envelope: missing eventId"),
    (env(eventId="null"), "invalid envelope: missing eventId"),
    (env(eventType='""'), "invalid envelope: missing eventType"),
    (env(tenantId=None), "invalid envelope: missing tenantId"),
    (env(timestamp='""'), "invalid envelope: missing timestamp"),
    (env(data=None), "invalid envelope: missing data"),
    (env(data="null"), None),  # present null passes
    (env(timestamp='"yesterday"'), "invalid envelope: invalid timestamp: yesterday"),
    (env(timestamp='"2024-01-02"'), "invalid envelope: invalid timestamp: 2024-01-02"),
    (env(timestamp='"2024-01-02T10:00:00"'), "invalid envelope: invalid timestamp: 2024-01-02T10:00:00"),
    (env(timestamp='"2024-01-02T10:00:00+0530"'), "invalid envelope: invalid timestamp: 2024-01-02T10:00:00+0530"),
    (env(timestamp='"2024-01-02T10:00:00+05:30"'), None),
    (env(timestamp='"2024-01-02T10:00:00.123456789Z"'), None),
    (env(version="-3"), None),  # negative versions pass validation (fail at the registry)
    (env(version="1.0"), "invalid envelope: json unmarshal: json: cannot unmarshal number 1 into Go struct field "
                         "rawEnvelope.version of type int"),
    ("{'version':1}", "invalid envelope: json unmarshal: malformed JSON"),
    (env(version="NaN"), "invalid envelope: json unmarshal: malformed JSON"),
    (env() + "] [2", "invalid envelope: json unmarshal: malformed JSON"),  # closes the array wrapper early
    ("1} {\"y\":2", "invalid envelope: json unmarshal: malformed JSON"),   # closes the object wrapper early
    (env(data='{"a":1,"a":2}'), None),  # duplicate keys inside data: present, decodes (last wins)
]


def test_validation_branches(spark):
    rows = [("cases", 0, i, v, "2024-01-01 00:00:00") for i, (v, _) in enumerate(CASES)]
    got = {r["offset"]: r["envelope_error"] for r in
           P.parse_and_validate(raw_frame(spark, rows)).select("offset", "envelope_error").collect()}
    for i, (v, want) in enumerate(CASES):
        assert got[i] == want, (v, got[i])


def test_timestamps_and_lenient_first_failure(spark):
    rows = [("cases", 0, 0, env(timestamp='"2024-01-02T10:00:00+05:30"',
                                firstFailureTime='"garbage"'), "2024-01-01 00:00:00"),
            ("cases", 0, 1, env(firstFailureTime='"2024-01-01T00:00:01Z"', retryCount="3"), "2024-01-01 00:00:00")]
    r = {x["offset"]: x for x in P.parse_and_validate(raw_frame(spark, rows)).collect()}
    assert str(r[0]["event_ts"]) == "2024-01-02 04:30:00"
    assert r[0]["first_failure_time"] is None and r[0]["envelope_error"] is None
    assert r[1]["retry_count"] == 3 and str(r[1]["first_failure_time"]) == "2024-01-01 00:00:01"


def test_affinity_key(spark):
    rows = [("cases", 0, 0, env(data='{"caseId":"c9"}'), "2024-01-01 00:00:00"),
            ("cases", 0, 1, env(data='{"caseId":""}'), "2024-01-01 00:00:00"),
            ("cases", 0, 2, env(data='{"caseId":7}'), "2024-01-01 00:00:00"),
            ("cases", 0, 3, env(data="5"), "2024-01-01 00:00:00"),
            ("cases", 0, 4, env(data="null"), "2024-01-01 00:00:00")]
    v = P.affinity_key(P.parse_and_validate(raw_frame(spark, rows)))
    got = [r["affinity_key"] for r in v.orderBy("offset").collect()]
    assert got == ["t1:c9", "t1", "t1", "t1", "t1"]


def test_handler_payload_errors(spark):
    from sluice.operators import handlers as H
    from sluice.operators import route as R
    rows = [("cases", 0, 0, env(data='{"visitId":"v"}'), "2024-01-01 00:00:00"),
            ("cases", 0, 1, env(data='{"visitId":12}'), "2024-01-01 00:00:00"),
            ("cases", 0, 2, env(data="5"), "2024-01-01 00:00:00"),
            ("cases", 0, 3, env(data="null"), "2024-01-01 00:00:00")]
    v = R.resolve_processor(P.parse_and_validate(raw_frame(spark, rows)), R.registry_frame(spark))
    got = [r["error"] for r in H.apply_handlers(v).orderBy("offset").collect()]
    assert got[0] is None and got[3] is None
    assert got[1] == ("business validation: invalid VISIT_APPROVED data: json: cannot unmarshal number "
                      "into Go struct field VisitApprovedData.visitId of type string")
    assert got[2] == ("business validation: invalid VISIT_APPROVED data: json: cannot unmarshal number "
                      "into Go value of type processor.VisitApprovedData")


def test_retry_envelope_checks(spark):
    good = ('{"eventId":"e1","originalTopic":"cases","retryCount":2,'
            '"nextRetryAfter":"2024-01-01T00:01:00Z","timestamp":"2024-01-01T00:00:00Z"}')
    rows = [("cases.retry", 0, 0, good, "2024-01-01 00:00:00"),
            ("cases.retry", 0, 1, '{"eventId":"e1"}', "2024-01-01 00:00:00"),
            ("cases.retry", 0, 2, '{"eventId":"e1","originalTopic":"c","nextRetryAfter":"soon"}',
             "2024-01-01 00:00:00")]
    r = [x["retry_error"] for x in P.parse_retry_envelope(raw_frame(spark, rows)).orderBy("offset").collect()]
    assert r[0] is None
    assert r[1] == "invalid retry envelope: invalid retry envelope: missing eventId or originalTopic"
    assert r[2] == 'invalid retry envelope: unmarshal retry envelope: parsing time "soon": not RFC 3339'


def test_payload_text_is_kept(spark):
    from conftest import raw_frame

    from sluice.operators import outcome as O
    head = '{"version":1,"eventId":"e","eventType":"VISIT_APPROVED","tenantId":"t","timestamp":"2024-01-01T00:00:00Z"'
    texts = ['{"visitId":"a","visitId":"b","caseId":"c9"}', '{"n":1.50,"m":0.1234567890123456789,"e":-2E+5}',
             '{"s":"q\\"1.50 , \\\\","u":"\\u00e9 \\/ é","k\\"2.0":[1.0,[],{}]}', '1.50', '"x\\"1.0\\n"', 'true', '[1.0]',
             '{"e":"🙂","f":["🙂 \\ud83d\\ude42 𝒳",{"🙂":1.0}]}', '"🙂\\u0001"']
    rows = [("cases", 0, i, f'{head},"data": {t}}}', "2024-01-01 00:00:00") for i, t in enumerate(texts)]
    rows.append(("cases", 0, 90, head + ',"data":{"a":1.0},"data":{"caseId":"z"}}', "2024-01-01 00:00:00"))
    rows.append(("cases", 0, 91, head + ',"data":{ "a" : [1.0 ,\t2] } }', "2024-01-01 00:00:00"))
    v = P.payload_text(P.affinity_key(P.parse_and_validate(raw_frame(spark, rows))))
    got = {r.offset: r for r in v.withColumn("payload", O.payload_json(F.col("value_str"), F.col("value_is_json"))).collect()}
    for i, t in enumerate(texts):
        assert got[i].envelope_error is None and got[i].data_json == t
        assert got[i].payload == f'{head},"data":{t}}}'
    assert got[0].affinity_key == "t:c9" and got[0].data_kind == "object"
    assert got[90].data_json == '{"caseId":"z"}' and got[90].affinity_key == "t:z"
    assert got[91].data_json == '{"a":[1.0,2]}' and got[91].payload == head + ',"data":{"a":[1.0,2]}}'


def test_names_without_case_last_one_wins(spark):
    """As a typed decoder: any case, the last of a name, null leaves the earlier value, the first misfit in the text is the error."""
    from conftest import raw_frame
    from sluice.operators import outcome as O
    tail = '"tenantId":"t","timestamp":"2024-01-01T00:00:00Z","data":{"caseId":"c1"}}'
    head = '{"version":1,"eventType":"VISIT_APPROVED",'
    texts = [head + '"EVENTID":"a",' + tail, head + '"eventId":"x","EventId":"b",' + tail, head + '"EVENTID":"x","eventId":"c",' + tail,
             head + '"eventId":"d","EVENTID":null,' + tail, head + '"eventid":5,"eventId":"e",' + tail, head + '"eventId":"f","VERSION":"1","tenantID":7,' + tail,
             head + '"eventId":"g",' + tail[:-1] + ',"DATA":{"caseId":"c2","n":1.50}}', head + '"eventId":"h",' + tail[:-1] + ',"Data":null}', '{"ver\u017fion":2,"eventId":"i","eventType":"E",' + tail]
    v = P.payload_text(P.affinity_key(P.parse_and_validate(raw_frame(spark, [("cases", 0, i, t, "2024-01-01 00:00:00") for i, t in enumerate(texts)]))))
    got = {r.offset: r for r in v.collect()}
    assert [got[i].event_id for i in (0, 1, 2, 3, 6, 7, 8)] == list("abcdghi") and got[8].version == 2
    assert got[4].decode_error == "json: cannot unmarshal number into Go struct field rawEnvelope.eventId of type string"
    assert got[5].decode_error == "json: cannot unmarshal string into Go struct field rawEnvelope.version of type int"
    assert got[6].data_json == '{"caseId":"c2","n":1.50}' and got[6].affinity_key == "t:c2" and got[7].data_json == "null" and got[7].has_data
    retry = O.to_retry_envelope(v.where("offset = 6").withColumns({"clock": F.col("timestamp"), "error": F.lit("x"), "first_failure_time": F.lit(None).cast("timestamp")}))
    assert '"data":{"caseId":"c2","n":1.50},' in retry.first().sink_value


def test_offsets_and_null_values(spark):
    from sluice.functions.clock import parse_rfc3339
    rows = [("2024-01-02T00:00:00-23:59",), ("2024-01-02T00:00:00.25+24:60",), ("2024-01-02T00:00:00+24:61",), ("2024-01-02T00:00:00+25:00",), ("2024-01-02T05:30:00+05:30",), ("2024-02-30T00:00:00Z",), (None,), ("x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(F.unix_micros(parse_rfc3339(F.col("s")))).collect()]
    day = 1704153600 * 10 ** 6
    assert got == [day + (23 * 3600 + 59 * 60) * 10 ** 6, day + 250_000 - 25 * 3600 * 10 ** 6, None, None, day, None, None, None]
    null = spark.createDataFrame([("cases", 0, 0, None)], "topic string, partition int, offset long, value binary")
    assert P.parse_and_validate(null).first().envelope_error == "invalid envelope: json unmarshal: unexpected end of JSON input"
