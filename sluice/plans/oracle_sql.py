"""DuckDB SQL twins of the registered queries (the correctness oracle).

``events`` is a pre-registered view; the message log is rebuilt in SQL with
the same rules as ``sluice.sources.fixtures``. Timestamps leave both engines as
epoch microseconds and doubles are rounded, so values hash identically.
"""
from __future__ import annotations

# The message log (FIXTURES.md §2) as a DuckDB CTE body.
MSGS = r"""
ev AS (
  SELECT event_id AS i, user_id AS u, ts, event_type AS etype_src, value AS amount, props,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_txt
  FROM events
),
ev2 AS (
  SELECT *,
    CASE WHEN i % 97 = 0 THEN 'refunds'
         ELSE ['cases','payments','visits','notifications'][i % 4 + 1] END AS topic,
    'e' || CAST(CASE WHEN i % 1000 = 999 THEN i - 999 WHEN i % 10 = 9 THEN i - 9 ELSE i END AS VARCHAR) AS eid,
    CASE WHEN i % 3 = 1 THEN 'NOTIFICATION_TRIGGERED' WHEN i % 9 = 2 THEN 'CASE_ASSIGNED'
         ELSE 'VISIT_APPROVED' END AS etype,
    CASE WHEN i % 53 = 0 THEN '0' WHEN i % 59 = 0 THEN '2' WHEN i % 101 = 0 THEN '"1"' ELSE '1' END AS vjson,
    't' || CAST(u % 8 AS VARCHAR) AS tenant
  FROM ev
),
ev3 AS (
  SELECT *,
    CASE WHEN i % 61 = 0 THEN '"yesterday"' WHEN i % 67 = 0 THEN '""'
         WHEN i % 109 = 0 THEN '"' || strftime(ts + INTERVAL 23 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+23:00"' ELSE '"' || ts_txt || '"' END AS ts_json,
    ',"agentId":"a' || CAST(u % 20 AS VARCHAR) || '","caseId":"c' || CAST(u AS VARCHAR)
      || '","approvedAt":"' || ts_txt || '"}' AS visit_tail
  FROM ev2
),
ev4 AS (
  SELECT *,
    CASE WHEN i % 71 = 0 THEN NULL WHEN i % 73 = 0 THEN 'null' WHEN i % 79 = 0 THEN '5'
         WHEN etype = 'NOTIFICATION_TRIGGERED' THEN
           '{"notificationId":"n' || CAST(i AS VARCHAR) || '","recipientId":"r' || CAST(u AS VARCHAR)
           || '","channel":"' || ['sms','email','push'][u % 3 + 1] || '","templateId":"tpl'
           || CAST(i % 4 AS VARCHAR) || '","payload":' || props || '}'
         WHEN i % 103 = 0 THEN '{"visitId":' || CAST(i AS VARCHAR) || visit_tail
         ELSE '{"visitId":"v' || CAST(i AS VARCHAR) || '"' || visit_tail END AS data_json,
    CASE WHEN i % 5 = 0 THEN ',"retryCount":' || CAST(i % 7 AS VARCHAR) END AS retry_json
  FROM ev3
),
ev5 AS (
  SELECT *,
    '{"version":' || vjson || CASE WHEN i % 107 = 0 THEN ',"eventId":"old","EVENTID":"' ELSE ',"eventId":"' END || eid || '","eventType":"' || etype || '","tenantId":"'
      || tenant || '","timestamp":' || ts_json || coalesce(',"data":' || data_json, '')
      || coalesce(retry_json, '') || '}' AS body
  FROM ev4
),
msgs AS (
  SELECT topic, CAST(u % 6 AS INTEGER) AS partition,
         CAST(row_number() OVER (PARTITION BY topic, u % 6 ORDER BY i) - 1 AS BIGINT) AS "offset",
         tenant AS key,
         CASE WHEN i % 83 = 0 THEN 'not json' WHEN i % 89 = 0 THEN body || ' x' ELSE body END AS value,
         ts AS "timestamp", i AS source_id,
         CASE WHEN etype_src = 'error' AND i % 13 = 0 THEN 'panic'
              WHEN etype_src = 'error' AND i % 2 = 0 THEN 'error' END AS fault,
         amount / 50 AS duration_s
  FROM ev5
)"""


def with_msgs(body: str, extra_ctes: str = "") -> str:
    ctes = MSGS + ("," + extra_ctes if extra_ctes else "")
    return "WITH " + ctes + "\n" + body


QUERIES: dict[str, str] = {}

QUERIES["read_messages"] = with_msgs("""
SELECT topic, partition, "offset", key, value, epoch_us("timestamp") AS timestamp_us, source_id
FROM msgs""")


# ---------------------------------------------------------------- helpers ---
def _kind(t: str) -> str:
    """DuckDB json_type -> JSON kind."""
    return (f"CASE {t} WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' "
            f"WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' "
            f"WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END")


def _word(k: str) -> str:
    return f"CASE WHEN {k} = 'int' THEN 'number' ELSE {k} END"


def _field_err(k: str, path: str, struct: str, field: str, target: str) -> str:
    ok = "'int'" if target == "int" else "'string'"
    word = (f"CASE WHEN {k} = 'number' AND {'true' if target == 'int' else 'false'} "
            f"THEN 'number ' || CAST(json_extract(value, '{path}') AS VARCHAR) ELSE {_word(k)} END")
    return (f"CASE WHEN {k} IS NOT NULL AND {k} <> 'null' AND {k} <> {ok} THEN 'json: cannot unmarshal ' "
            f"|| {word} || ' into Go struct field {struct}.{field} of type {target}' END")


ENV_FIELDS = [("version", "int"), ("eventId", "string"), ("eventType", "string"), ("tenantId", "string"),
              ("timestamp", "string"), ("retryCount", "int"), ("failureReason", "string"),
              ("firstFailureTime", "string")]
RFC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def _rfc(s: str) -> str:
    off = f"regexp_extract({s}, '([+-])(\\d{{2}}):(\\d{{2}})$'"
    seconds = f"coalesce(CASE {off}, 1) WHEN '-' THEN -1 WHEN '+' THEN 1 END * (CAST({off}, 2) AS BIGINT) * 3600 + CAST({off}, 3) AS BIGINT) * 60), 0)"
    return (f"CASE WHEN regexp_full_match({s}, '{RFC}') THEN epoch_us(try_cast(regexp_replace({s}, '[+-]\\d{{2}}:\\d{{2}}$', 'Z') AS TIMESTAMPTZ)) "
            f"- CASE WHEN {s} LIKE '%Z' THEN 0 ELSE {seconds} END * 1000000 END")


# the last member of a name counts, whatever its case (the fixture writes eventId twice)
EVENT_ID = "coalesce(json_extract(value, '$.EVENTID'), json_extract(value, '$.eventId'))"


def _kinds_select(fields, prefix="$.") -> str:
    return ",\n    ".join(
        f"CASE WHEN valid THEN {_kind(f'json_type({EVENT_ID})' if n == 'eventId' else f'json_type(value, {chr(39)}{prefix}{n}{chr(39)})')} END AS k_{n}"
        for n, _ in fields)


PARSED = r"""
m0 AS (SELECT * FROM msgs WHERE topic NOT LIKE '%.retry'),
p0 AS (SELECT *, json_valid(value) AS valid FROM m0),
p1 AS (SELECT *,
    CASE WHEN valid THEN """ + _kind("json_type(value)") + """ END AS k_top,
    """ + _kinds_select(ENV_FIELDS + [("data", "raw")]) + """
  FROM p0),
p2 AS (SELECT *,
    CASE WHEN trim(value) = '' THEN 'unexpected end of JSON input'
         WHEN NOT valid THEN 'malformed JSON'
         WHEN k_top NOT IN ('object', 'null') THEN 'json: cannot unmarshal ' || """ + _word("k_top") + """
              || ' into Go value of type event.rawEnvelope'
         ELSE coalesce(""" + ",\n           ".join(
    _field_err(f"k_{n}", f"$.{n}", "rawEnvelope", n, t) for n, t in ENV_FIELDS) + """) END AS decode_error
  FROM p1),
parsed AS (SELECT *,
    CASE WHEN decode_error IS NULL AND k_version = 'int' THEN CAST(json_extract(value, '$.version') AS BIGINT) ELSE 0 END AS version,
    CASE WHEN decode_error IS NULL AND k_eventId = 'string' THEN json_extract_string(""" + EVENT_ID + """, '$') ELSE '' END AS event_id,
    CASE WHEN decode_error IS NULL AND k_eventType = 'string' THEN json_extract_string(value, '$.eventType') ELSE '' END AS event_type,
    CASE WHEN decode_error IS NULL AND k_tenantId = 'string' THEN json_extract_string(value, '$.tenantId') ELSE '' END AS tenant_id,
    CASE WHEN decode_error IS NULL AND k_timestamp = 'string' THEN json_extract_string(value, '$.timestamp') ELSE '' END AS timestamp_str,
    CASE WHEN decode_error IS NULL THEN coalesce(k_data IS NOT NULL, false) ELSE false END AS has_data,
    CASE WHEN decode_error IS NOT NULL OR k_data IS NULL THEN NULL WHEN k_data = 'null' THEN 'null'
         ELSE CAST(json_extract(value, '$.data') AS VARCHAR) END AS data_json,
    CASE WHEN decode_error IS NULL AND k_retryCount = 'int' THEN CAST(json_extract(value, '$.retryCount') AS BIGINT) ELSE 0 END AS retry_count,
    CASE WHEN decode_error IS NULL AND k_failureReason = 'string' THEN json_extract_string(value, '$.failureReason') ELSE '' END AS failure_reason,
    CASE WHEN decode_error IS NULL AND k_firstFailureTime = 'string' THEN json_extract_string(value, '$.firstFailureTime') ELSE '' END AS first_failure_str
  FROM p2),
validated AS (SELECT *,
    CASE WHEN decode_error IS NOT NULL THEN 'invalid envelope: json unmarshal: ' || decode_error
         WHEN version = 0 THEN 'invalid envelope: missing or zero version'
         WHEN event_id = '' THEN 'invalid envelope: missing eventId'
         WHEN event_type = '' THEN 'invalid envelope: missing eventType'
         WHEN tenant_id = '' THEN 'invalid envelope: missing tenantId'
         WHEN timestamp_str = '' THEN 'invalid envelope: missing timestamp'
         WHEN NOT has_data THEN 'invalid envelope: missing data'
         WHEN """ + _rfc("timestamp_str") + """ IS NULL THEN 'invalid envelope: invalid timestamp: ' || timestamp_str
    END AS envelope_error,
    """ + _rfc("timestamp_str") + """ AS event_ts_us,
    CASE WHEN first_failure_str <> '' THEN """ + _rfc("first_failure_str") + """ END AS first_failure_us,
    epoch_us("timestamp") AS clock_us
  FROM parsed),
registry AS (SELECT * FROM (VALUES ('VISIT_APPROVED', 1::BIGINT, 'VISIT_APPROVED'),
                                   ('NOTIFICATION_TRIGGERED', 1::BIGINT, 'NOTIFICATION_TRIGGERED'))
             AS r(event_type, version, processor)),
pools AS (SELECT * FROM (VALUES ('cases', 50), ('payments', 20), ('visits', 20), ('notifications', 50))
          AS t(topic, lanes)),
resolved AS (SELECT v.*, r.processor, p.lanes FROM validated v
  LEFT JOIN registry r ON v.envelope_error IS NULL AND r.event_type = v.event_type AND r.version = v.version
  LEFT JOIN pools p ON p.topic = v.topic),
"""


def _payload_err(fields, struct, go_type) -> str:
    k = _kind("json_type(value, '$.data')")
    errs = ",\n        ".join(
        _field_err(_kind(f"json_type(value, '$.data.{f}')"), f"$.data.{f}", struct, f, "string")
        for f in fields)
    return (f"CASE WHEN coalesce({k}, 'null') NOT IN ('object', 'null') THEN 'json: cannot unmarshal ' || "
            f"{_word(k)} || ' into Go value of type {go_type}' "
            f"WHEN {k} = 'object' THEN coalesce({errs}) END")


VISIT_ERR = _payload_err(["visitId", "agentId", "caseId", "approvedAt"], "VisitApprovedData",
                         "processor.VisitApprovedData")
NOTIF_ERR = _payload_err(["notificationId", "recipientId", "channel", "templateId"],
                         "NotificationTriggeredData", "processor.NotificationTriggeredData")

FNV = ("list_reduce(list_transform(string_split(affinity_key, ''), lambda c: unicode(c)::BIGINT), "
       "lambda h, b: (xor(h, b) * 16777619) % 4294967296, 2166136261::BIGINT)")

HANDLED = PARSED + r"""
aff AS (SELECT *,
    CASE WHEN json_type(value, '$.data') = 'OBJECT' AND json_type(value, '$.data.caseId') = 'VARCHAR'
              AND json_extract_string(value, '$.data.caseId') <> ''
         THEN tenant_id || ':' || json_extract_string(value, '$.data.caseId') ELSE tenant_id END AS affinity_key,
    (envelope_error IS NULL AND processor IS NOT NULL AND lanes IS NOT NULL) AS routed
  FROM resolved),
h0 AS (SELECT *,
    CASE WHEN routed AND processor = 'VISIT_APPROVED' THEN """ + VISIT_ERR + """ END AS visit_err,
    CASE WHEN routed AND processor = 'NOTIFICATION_TRIGGERED' THEN """ + NOTIF_ERR + """ END AS notif_err
  FROM aff),
handled AS (SELECT *,
    CASE WHEN NOT routed THEN NULL
         WHEN visit_err IS NOT NULL OR notif_err IS NOT NULL THEN 'business_validation'
         WHEN fault = 'panic' THEN 'panic' WHEN fault = 'error' THEN 'processing_error' END AS error_class,
    CASE WHEN NOT routed THEN NULL
         WHEN visit_err IS NOT NULL THEN 'business validation: invalid VISIT_APPROVED data: ' || visit_err
         WHEN notif_err IS NOT NULL THEN 'business validation: invalid NOTIFICATION_TRIGGERED data: ' || notif_err
         WHEN fault = 'panic' THEN 'panic: simulated handler panic'
         WHEN fault = 'error' THEN 'simulated handler error: downstream unavailable' END AS error,
    CASE WHEN routed THEN """ + FNV + """ % lanes END AS lane
  FROM h0),
"""

# the claim fold, literally: one step per event of an id, in arrival order
def _fold(ok_expr: str, ttl_us: int = 48 * 3600 * 1_000_000) -> str:
    return f"""
dd_base AS (SELECT event_id AS k, clock_us AS t, ({ok_expr}) AS ok, topic, partition, "offset",
    row_number() OVER (PARTITION BY event_id ORDER BY clock_us, topic, partition, "offset") AS rn
  FROM handled WHERE routed),
dd_fold(k, rn, claim, status) AS (
  SELECT k, rn, CASE WHEN ok THEN t END, 'claimed' FROM dd_base WHERE rn = 1
  UNION ALL
  SELECT b.k, b.rn,
    CASE WHEN f.claim IS NOT NULL AND b.t < f.claim + {ttl_us} THEN f.claim WHEN b.ok THEN b.t END,
    CASE WHEN f.claim IS NOT NULL AND b.t < f.claim + {ttl_us} THEN 'duplicate' ELSE 'claimed' END
  FROM dd_fold f JOIN dd_base b ON b.k = f.k AND b.rn = f.rn + 1),
dedup AS (SELECT h.*, f.status AS dedup_status FROM handled h
  LEFT JOIN dd_base b ON b.topic = h.topic AND b.partition = h.partition AND b."offset" = h."offset"
  LEFT JOIN dd_fold f ON f.k = b.k AND f.rn = b.rn),"""


# rows in order of arrival (``run``, then time): a claim holds the times less than a window away, before and after it
def _stream_fold(run: str, ttl_us: int = 48 * 3600 * 1_000_000) -> str:
    held = f"list_any_value([true FOR s IN f.claims IF abs(b.t - s) < {ttl_us}]) IS NOT NULL"
    return f"""
dd_base AS (SELECT event_id AS k, clock_us AS t, error IS NULL AS ok, topic, partition, "offset",
    row_number() OVER (PARTITION BY event_id ORDER BY {run}, clock_us, topic, partition, "offset") AS rn
  FROM handled WHERE routed),
dd_fold(k, rn, claims, status) AS (
  SELECT k, rn, CASE WHEN ok THEN [t] ELSE []::BIGINT[] END, 'claimed' FROM dd_base WHERE rn = 1
  UNION ALL
  SELECT b.k, b.rn, CASE WHEN b.ok AND NOT ({held}) THEN list_append(f.claims, b.t) ELSE f.claims END,
    CASE WHEN {held} THEN 'duplicate' ELSE 'claimed' END
  FROM dd_fold f JOIN dd_base b ON b.k = f.k AND b.rn = f.rn + 1),
dedup AS (SELECT h.*, f.status AS dedup_status FROM handled h
  LEFT JOIN dd_base b ON b.topic = h.topic AND b.partition = h.partition AND b."offset" = h."offset"
  LEFT JOIN dd_fold f ON f.k = b.k AND f.rn = b.rn),"""


OUTCOMES = r"""
triaged AS (SELECT *,
    CASE WHEN envelope_error IS NOT NULL THEN envelope_error
         WHEN processor IS NULL THEN 'no processor registered for event type: ' || event_type || ' v' || CAST(version AS VARCHAR)
         WHEN lanes IS NULL THEN 'no worker pool for topic' END AS final_reason
  FROM dedup),
outcomes AS (SELECT *,
    CASE WHEN final_reason IS NOT NULL THEN 'dlq'
         WHEN dedup_status = 'duplicate' THEN 'duplicate'
         WHEN error IS NULL THEN 'processed'
         WHEN error_class NOT IN ('invalid_envelope', 'business_validation') AND retry_count < 5 THEN 'retry'
         ELSE 'dlq' END AS outcome
  FROM triaged),
classified AS (SELECT *,
    coalesce(final_reason, CASE WHEN outcome IN ('retry', 'dlq') THEN error END) AS reason,
    CASE WHEN outcome = 'retry' THEN topic || '.retry' WHEN outcome = 'dlq' THEN topic || '.dlq' END AS sink_topic,
    CASE WHEN envelope_error IS NOT NULL THEN 'raw' WHEN outcome = 'dlq' THEN 'event' END AS dlq_kind
  FROM outcomes)"""

TRIAGED = HANDLED + _fold("error IS NULL") + OUTCOMES

IDS = 'topic, partition, "offset"'


def q(ctes: str, body: str) -> str:
    extra = ctes.strip().rstrip(",")
    return "WITH RECURSIVE " + MSGS + ("," + extra if extra else "") + "\n" + body


QUERIES["parse_envelope"] = q(PARSED, f"""
SELECT {IDS}, decode_error, version, event_id, event_type, tenant_id, timestamp_str, has_data, data_json,
       retry_count, failure_reason, first_failure_str FROM parsed""")
QUERIES["validate_envelope"] = q(PARSED, f"""
SELECT {IDS}, envelope_error AS reason, event_ts_us FROM validated""")
QUERIES["parse_rfc3339"] = q(PARSED, f"""
SELECT {IDS}, timestamp_str, {_rfc('timestamp_str')} AS ts_us FROM parsed""")
QUERIES["parse_retry_metadata"] = q(PARSED, f"""
SELECT {IDS}, retry_count, failure_reason, first_failure_us FROM validated WHERE envelope_error IS NULL""")
QUERIES["affinity_key"] = q(HANDLED, f"""
SELECT {IDS}, tenant_id, affinity_key FROM aff WHERE envelope_error IS NULL""")
QUERIES["enrich_context"] = q(HANDLED, f"""
SELECT tenant_id, event_id, {IDS}, clock_us AS processing_start_us, processor FROM handled WHERE routed""")
QUERIES["resolve_processor"] = q(PARSED, f"""
SELECT {IDS}, event_type, version, processor FROM resolved WHERE envelope_error IS NULL""")
QUERIES["unknown_event_types"] = q(PARSED, f"""
SELECT {IDS}, event_type, version,
  'no processor registered for event type: ' || event_type || ' v' || CAST(version AS VARCHAR) AS reason
FROM resolved WHERE envelope_error IS NULL AND processor IS NULL""")
QUERIES["has_processor"] = q(PARSED, f"""
SELECT {IDS}, event_type, version FROM resolved WHERE envelope_error IS NULL AND processor IS NOT NULL""")
QUERIES["unrouted_topics"] = q(PARSED, f"""
SELECT {IDS}, event_id, 'no worker pool for topic' AS reason FROM resolved
WHERE envelope_error IS NULL AND processor IS NOT NULL AND lanes IS NULL""")
QUERIES["classify_outcome"] = q(TRIAGED, f"""
SELECT {IDS}, event_id, outcome, reason, sink_topic FROM classified""")
STREAMED = HANDLED + _stream_fold(
    "CASE WHEN source_id % 7 = 3 THEN 2 WHEN clock_us < epoch_us(TIMESTAMPTZ '2024-01-15 00:00:00+00') THEN 0 ELSE 1 END") + OUTCOMES
QUERIES["start_triage_stream"] = q(STREAMED, f"""
SELECT {IDS}, event_id, outcome, reason, sink_topic, dedup_status FROM classified""")
QUERIES["run_triage"] = q(TRIAGED, """
SELECT tenant_id, topic, outcome, reason, count(*) AS n FROM classified GROUP BY ALL""")


# ======================================================= retry path & records
def _jstr(x: str) -> str:
    return f"coalesce(CAST(to_json(CAST({x} AS VARCHAR)) AS VARCHAR), 'null')"


def _jtime(us: str) -> str:
    return (f"CASE WHEN {us} IS NULL THEN '\"0001-01-01T00:00:00Z\"' ELSE '\"' || "
            f"regexp_replace(regexp_replace(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), "
            f"'\\.$', '') || 'Z\"' END")


def _payload(v: str) -> str:
    return f"CASE WHEN json_valid({v}) THEN CAST(json({v}) AS VARCHAR) ELSE {_jstr(v)} END"


BACKOFF = "[30, 60, 300, 900, 1800][greatest(1, least(retry_count + 1, 5))]"

RETRY_JSON = ("'{\"version\":' || CAST(version AS VARCHAR) || ',\"eventId\":' || " + _jstr("event_id")
              + " || ',\"eventType\":' || " + _jstr("event_type") + " || ',\"tenantId\":' || "
              + _jstr("tenant_id") + " || ',\"timestamp\":' || " + _jtime("event_ts_us")
              + " || ',\"data\":' || coalesce(data_json, 'null') || ',\"originalTopic\":' || " + _jstr("topic")
              + " || ',\"retryCount\":' || CAST(retry_count + 1 AS VARCHAR) || ',\"failureReason\":' || "
              + _jstr("error") + " || ',\"firstFailureTime\":' || " + _jtime("coalesce(first_failure_us, clock_us)")
              + " || ',\"lastFailureTime\":' || " + _jtime("clock_us") + " || ',\"nextRetryAfter\":' || "
              + _jtime(f"clock_us + {BACKOFF} * 1000000") + " || '}'")

RAW_DLQ_JSON = ("'{\"originalPayload\":' || " + _payload("value") + " || ',\"topic\":' || " + _jstr("topic")
                + " || ',\"partition\":' || CAST(partition AS VARCHAR) || ',\"offset\":' || CAST(\"offset\" AS VARCHAR)"
                + " || ',\"eventType\":\"\",\"tenantId\":\"\",\"eventId\":\"\",\"failureReason\":' || "
                + _jstr("reason") + " || ',\"retryCount\":0,\"timestamp\":' || " + _jtime("clock_us") + " || '}'")

EVENT_DLQ_JSON = ("'{\"originalPayload\":' || " + _payload("value") + " || ',\"topic\":' || " + _jstr("topic")
                  + " || ',\"partition\":' || CAST(partition AS VARCHAR) || ',\"offset\":' || CAST(\"offset\" AS VARCHAR)"
                  + " || ',\"eventType\":' || " + _jstr("event_type") + " || ',\"tenantId\":' || " + _jstr("tenant_id")
                  + " || ',\"eventId\":' || " + _jstr("event_id") + " || ',\"failureReason\":' || " + _jstr("reason")
                  + " || ',\"retryCount\":' || CAST(CASE WHEN processor IS NULL OR lanes IS NULL THEN 0 ELSE retry_count END AS VARCHAR)"
                  + " || ',\"timestamp\":' || " + _jtime("clock_us") + " || '}'")

RETRY_FIELDS_SQL = [("version", "int"), ("eventId", "string"), ("eventType", "string"), ("tenantId", "string"),
                    ("timestamp", "time"), ("data", "raw"), ("originalTopic", "string"), ("retryCount", "int"),
                    ("failureReason", "string"), ("firstFailureTime", "time"), ("lastFailureTime", "time"),
                    ("nextRetryAfter", "time")]


def _time_err(n: str) -> str:
    k = f"k_{n}"
    s = f"json_extract_string(value, '$.{n}')"
    return (f"CASE WHEN {k} IS NULL OR {k} = 'null' THEN NULL WHEN {k} <> 'string' "
            f"THEN 'Time.UnmarshalJSON: input is not a JSON string' "
            f"WHEN ({_rfc(s)}) IS NULL THEN 'parsing time \"' || {s} || '\": not RFC 3339' END")


def _rerr(n, t):
    if t in ("int", "string"):
        return _field_err(f"k_{n}", f"$.{n}", "RetryEnvelope", n, t)
    if t == "time":
        return _time_err(n)
    return None


def _rtime(n: str) -> str:
    return f"CASE WHEN k_{n} = 'string' THEN {_rfc(f'json_extract_string(value, {chr(39)}$.{n}{chr(39)})')} END"


def _rs(n: str) -> str:
    if n == "eventId":
        return f"CASE WHEN k_eventId = 'string' THEN json_extract_string({EVENT_ID}, '$') ELSE '' END"
    return f"CASE WHEN k_{n} = 'string' THEN json_extract_string(value, '$.{n}') ELSE '' END"


def _ri(n: str) -> str:
    return f"CASE WHEN k_{n} = 'int' THEN CAST(json_extract(value, '$.{n}') AS BIGINT) ELSE 0 END"


RETRY_LOG = TRIAGED + r""",
retry_out AS (SELECT *, """ + RETRY_JSON + r""" AS rvalue,
    """ + BACKOFF + r""" AS backoff_s FROM classified WHERE outcome = 'retry'),
rlog0 AS (
  SELECT topic || '.retry' AS topic, partition, tenant_id AS key, rvalue AS value, clock_us AS ts_us,
         topic AS src_topic, "offset" AS src_offset FROM retry_out
  UNION ALL
  SELECT 'payments.retry', partition, key, value, epoch_us("timestamp"), topic, "offset"
  FROM msgs WHERE topic = 'payments' AND source_id % 11 = 0),
rlog AS (SELECT topic, partition, key, value, ts_us,
    CAST(row_number() OVER (PARTITION BY topic, partition ORDER BY ts_us, src_topic, src_offset) - 1 AS BIGINT) AS "offset"
  FROM rlog0),
r0 AS (SELECT *, json_valid(value) AS valid FROM rlog),
r1 AS (SELECT *,
    CASE WHEN valid THEN """ + _kind("json_type(value)") + """ END AS k_top,
    """ + _kinds_select(RETRY_FIELDS_SQL) + """
  FROM r0),
r2 AS (SELECT *,
    CASE WHEN trim(value) = '' THEN 'unexpected end of JSON input'
         WHEN NOT valid THEN 'malformed JSON'
         WHEN k_top NOT IN ('object', 'null') THEN 'json: cannot unmarshal ' || """ + _word("k_top") + """
              || ' into Go value of type retry.RetryEnvelope'
         ELSE coalesce(""" + ",\n           ".join(
    e for e in (_rerr(n, t) for n, t in RETRY_FIELDS_SQL) if e) + """) END AS decode_error
  FROM r1),
r3 AS (SELECT * REPLACE (""" + ", ".join(
    f"CASE WHEN decode_error IS NULL THEN k_{n} END AS k_{n}" for n, _ in RETRY_FIELDS_SQL) + """)
  FROM r2),
rparsed AS (SELECT *,
    """ + _ri("version") + """ AS version, """ + _rs("eventId") + """ AS event_id,
    """ + _rs("eventType") + """ AS event_type, """ + _rs("tenantId") + """ AS tenant_id,
    """ + _rtime("timestamp") + """ AS event_ts_us,
    CASE WHEN k_data IS NULL THEN NULL WHEN k_data = 'null' THEN 'null'
         ELSE CAST(json_extract(value, '$.data') AS VARCHAR) END AS data_json,
    """ + _rs("originalTopic") + """ AS original_topic, """ + _ri("retryCount") + """ AS retry_count,
    """ + _rs("failureReason") + """ AS failure_reason, """ + _rtime("firstFailureTime") + """ AS first_failure_us,
    """ + _rtime("nextRetryAfter") + """ AS next_retry_after_us,
    (k_nextRetryAfter IS NULL OR k_nextRetryAfter = 'null') AS next_retry_zero
  FROM r3),
rvalid AS (SELECT *,
    CASE WHEN decode_error IS NOT NULL THEN 'invalid retry envelope: unmarshal retry envelope: ' || decode_error
         WHEN event_id = '' OR original_topic = '' THEN 'invalid retry envelope: invalid retry envelope: missing eventId or originalTopic'
    END AS retry_error
  FROM rparsed)"""


def _us(ts_text: str) -> str:
    return f"epoch_us(TIMESTAMPTZ '{ts_text}')"


def _timeline(release: str, now: str) -> str:
    """Ends of all schedules up to ``now``, ``release`` being the time of the tick at or after ``ready`` (NULL: none)."""
    return f"""(SELECT *, CASE least(release, expiry, next_us, {_us(now)}) WHEN next_us THEN 'replaced' WHEN expiry THEN 'expired'
    WHEN release THEN 'released' ELSE 'pending' END AS "end",
    CASE WHEN "end" <> 'pending' THEN least(release, expiry, next_us) END AS ended_at_us
  FROM (SELECT *, scheduled_at_us + 86400000000 AS expiry, {release} AS release
        FROM (SELECT *, CASE WHEN due_s >= 0 THEN greatest(due_s * 1000000, scheduled_at_us) END AS ready FROM (
          SELECT event_id, original_topic, retry_count, ts_us AS scheduled_at_us,
            CASE WHEN next_retry_zero THEN -62135596800 ELSE CAST(floor(next_retry_after_us / 1000000) AS BIGINT) END AS due_s,
            row_number() OVER w AS seq, lead(ts_us) OVER w AS next_us
          FROM rvalid WHERE retry_error IS NULL AND ts_us <= {_us(now)}
          WINDOW w AS (PARTITION BY event_id ORDER BY ts_us, topic, partition, "offset")))))"""


def _epoch(ts_text: str) -> str:
    return f"CAST(floor(epoch_us(TIMESTAMPTZ '{ts_text}') / 1000000) AS BIGINT)"


NOW_DUE, NOW_TICK1, NOW_TICK2, NOW_END = "2024-01-16 00:00:00+00", "2024-01-10 00:00:00+00", "2024-01-20 00:00:00+00", "2024-06-01 00:00:00+00"


def _as_of(now: str) -> str:
    """The schedule as of a time: latest record of each id up to it."""
    return (f"(SELECT * FROM rvalid JOIN (SELECT event_id AS e, max(struct_pack(a := ts_us, b := topic, c := partition, d := \"offset\")) AS last FROM rvalid "
            f"WHERE retry_error IS NULL AND ts_us <= {_us(now)} GROUP BY event_id) ON e = event_id AND last = struct_pack(a := ts_us, b := topic, c := partition, d := \"offset\"))")


def _due(now: str) -> str:
    return (f"SELECT *, ts_us AS scheduled_at_us, CAST(floor(next_retry_after_us / 1000000) AS BIGINT) AS due_s FROM {_as_of(now)} "
            f"WHERE NOT next_retry_zero AND due_s BETWEEN 0 AND {_epoch(now)} AND {_us(now)} < ts_us + 86400000000")


def _not_first(src: str) -> str:
    return f"(SELECT * FROM ({src}) WHERE (event_id, scheduled_at_us) NOT IN (SELECT (event_id, scheduled_at_us) FROM ({_due(NOW_TICK1)})))"


REPUBLISH_JSON = ("'{\"version\":' || CAST(version AS VARCHAR) || ',\"eventId\":' || " + _jstr("event_id")
                  + " || ',\"eventType\":' || " + _jstr("event_type") + " || ',\"tenantId\":' || " + _jstr("tenant_id")
                  + " || ',\"timestamp\":' || " + _jtime("event_ts_us") + " || ',\"data\":' || coalesce(data_json, 'null')"
                  + " || ',\"retryCount\":' || CAST(retry_count AS VARCHAR) || ',\"failureReason\":' || "
                  + _jstr("failure_reason") + " || ',\"firstFailureTime\":' || " + _jtime("first_failure_us") + " || '}'")

QUERIES["split_retry_topics"] = q(RETRY_LOG, """
SELECT topic, CASE WHEN topic LIKE '%.retry' THEN 'schedule' ELSE 'process' END AS path, count(*) AS n
FROM (SELECT topic FROM msgs UNION ALL SELECT topic FROM rlog) GROUP BY ALL""")
QUERIES["invalid_envelopes"] = q(PARSED, f"""
SELECT {IDS}, envelope_error AS reason FROM validated WHERE envelope_error IS NOT NULL""")
QUERIES["to_raw_dlq_record"] = q(PARSED, f"""
SELECT {IDS}, key AS sink_key, {RAW_DLQ_JSON.replace('_jstr_reason', '')} AS sink_value,
       json_valid(value) AS payload_is_json
FROM (SELECT *, envelope_error AS reason FROM validated WHERE envelope_error IS NOT NULL)""")
QUERIES["write_dlq_raw"] = q(RETRY_LOG, f"""
SELECT topic || '.dlq' AS sink_topic, key AS sink_key, {RAW_DLQ_JSON} AS sink_value
FROM (SELECT topic, partition, "offset", key, value, clock_us, envelope_error AS reason FROM validated
      WHERE envelope_error IS NOT NULL
      UNION ALL
      SELECT topic, partition, "offset", key, value, ts_us, retry_error FROM rvalid WHERE retry_error IS NOT NULL)""")
QUERIES["to_dlq_record"] = q(TRIAGED, f"""
SELECT {IDS}, tenant_id AS sink_key, {EVENT_DLQ_JSON} AS sink_value FROM classified WHERE dlq_kind = 'event'""")
QUERIES["write_dlq"] = q(TRIAGED, f"""
SELECT sink_topic, CASE WHEN dlq_kind = 'raw' THEN key ELSE tenant_id END AS sink_key,
       CASE WHEN dlq_kind = 'raw' THEN {RAW_DLQ_JSON} ELSE {EVENT_DLQ_JSON} END AS sink_value
FROM classified WHERE outcome = 'dlq'""")
QUERIES["to_retry_envelope"] = q(RETRY_LOG, f"""
SELECT {IDS}, tenant_id AS sink_key, rvalue AS sink_value FROM retry_out""")
QUERIES["write_retry"] = q(RETRY_LOG, """
SELECT sink_topic, tenant_id AS sink_key, rvalue AS sink_value FROM retry_out""")
QUERIES["parse_visit_approved"] = q(HANDLED, f"""
SELECT {IDS},
  CASE WHEN json_type(value, '$.data.visitId') = 'VARCHAR' THEN json_extract_string(value, '$.data.visitId') END AS visit_id,
  CASE WHEN json_type(value, '$.data.agentId') = 'VARCHAR' THEN json_extract_string(value, '$.data.agentId') END AS agent_id,
  CASE WHEN json_type(value, '$.data.caseId') = 'VARCHAR' THEN json_extract_string(value, '$.data.caseId') END AS case_id,
  CASE WHEN json_type(value, '$.data.approvedAt') = 'VARCHAR' THEN json_extract_string(value, '$.data.approvedAt') END AS approved_at,
  CASE WHEN visit_err IS NOT NULL THEN 'business validation: invalid VISIT_APPROVED data: ' || visit_err END AS payload_error
FROM h0 WHERE routed AND processor = 'VISIT_APPROVED'""")
QUERIES["parse_notification_triggered"] = q(HANDLED, f"""
SELECT {IDS},
  CASE WHEN json_type(value, '$.data.notificationId') = 'VARCHAR' THEN json_extract_string(value, '$.data.notificationId') END AS notification_id,
  CASE WHEN json_type(value, '$.data.recipientId') = 'VARCHAR' THEN json_extract_string(value, '$.data.recipientId') END AS recipient_id,
  CASE WHEN json_type(value, '$.data.channel') = 'VARCHAR' THEN json_extract_string(value, '$.data.channel') END AS channel,
  CASE WHEN json_type(value, '$.data.templateId') = 'VARCHAR' THEN json_extract_string(value, '$.data.templateId') END AS template_id,
  CASE WHEN json_type(value, '$.data') = 'OBJECT' THEN CAST(json_extract(value, '$.data.payload') AS VARCHAR) END AS payload_json,
  CASE WHEN notif_err IS NOT NULL THEN 'business validation: invalid NOTIFICATION_TRIGGERED data: ' || notif_err END AS payload_error
FROM h0 WHERE routed AND processor = 'NOTIFICATION_TRIGGERED'""")
QUERIES["parse_retry_envelope"] = q(RETRY_LOG, f"""
SELECT {IDS}, event_id, original_topic, retry_count, failure_reason, first_failure_us, next_retry_after_us,
       retry_error AS reason FROM rvalid""")
QUERIES["invalid_retry_envelopes"] = q(RETRY_LOG, f"""
SELECT {IDS}, retry_error AS reason FROM rvalid WHERE retry_error IS NOT NULL""")
QUERIES["to_republish_envelope"] = q(RETRY_LOG, f"""
SELECT event_id, original_topic AS sink_topic, tenant_id AS sink_key, {REPUBLISH_JSON} AS sink_value
FROM ({_due(NOW_DUE)})""")
QUERIES["write_republished"] = q(RETRY_LOG, f"""
SELECT original_topic AS sink_topic, tenant_id AS sink_key, {REPUBLISH_JSON} AS sink_value
FROM ({_due(NOW_DUE)})""")

# ------------------------------------------------------------ scalar logic ---
RAN = "classified WHERE routed AND dedup_status = 'claimed'"
QUERIES["is_retriable"] = q(TRIAGED, f"""
SELECT {IDS}, error_class,
  (error_class IS NOT NULL AND error_class NOT IN ('invalid_envelope', 'business_validation',
   'unknown_event_type', 'no_pool')) AS retriable
FROM {RAN} AND error IS NOT NULL""")
QUERIES["should_retry"] = q(TRIAGED, f"""
SELECT {IDS}, retry_count, retry_count < 5 AS should_retry FROM {RAN} AND error IS NOT NULL""")
QUERIES["next_retry_after"] = q(RETRY_LOG, f"""
SELECT {IDS}, retry_count + 1 AS retry_count_next, CAST(backoff_s AS BIGINT) AS backoff_s,
       clock_us + backoff_s * 1000000 AS next_retry_after_us FROM retry_out""")
QUERIES["carry_failure_history"] = q(RETRY_LOG, f"""
SELECT {IDS}, coalesce(first_failure_us, clock_us) AS first_failure_us, clock_us AS last_failure_us,
       error AS failure_reason FROM retry_out""")
QUERIES["derived_topic"] = q("", f"""
SELECT {IDS}, topic || '.retry' AS retry_topic, topic || '.dlq' AS dlq_topic FROM msgs""")
QUERIES["lane_id"] = q(HANDLED, f"""
SELECT {IDS}, affinity_key, lanes, lane FROM handled WHERE routed""")
QUERIES["apply_handlers"] = q(HANDLED, f"""
SELECT {IDS}, processor, error_class, error FROM handled WHERE routed""")

# --------------------------------------------------------------- stateful ---
QUERIES["dedup_claims"] = q(HANDLED + _fold("true"), f"""
SELECT {IDS}, event_id, dedup_status FROM dedup WHERE routed""")
QUERIES["dedup_release"] = q(TRIAGED, f"""
SELECT {IDS}, event_id, dedup_status FROM dedup WHERE routed""")
QUERIES["run_triage_two_runs"] = QUERIES["classify_outcome"]
QUERIES["dedup_within_watermark"] = q(HANDLED, """
SELECT event_id, min(clock_us) // 604800000000 AS first_slice FROM handled WHERE routed GROUP BY event_id""")
QUERIES["schedule_retries"] = q(RETRY_LOG, f"""
SELECT event_id, seq, due_s, scheduled_at_us, original_topic, retry_count, "end", ended_at_us
FROM {_timeline("CAST(ceil(ready / 1000000) AS BIGINT) * 1000000", NOW_END)}""")
QUERIES["retry_ends"] = q(RETRY_LOG, f"""
SELECT event_id, seq, due_s, scheduled_at_us, "end", ended_at_us
FROM {_timeline(f"CASE WHEN ready <= {_us(NOW_TICK1)} THEN {_us(NOW_TICK1)} WHEN ready <= {_us(NOW_TICK2)} THEN {_us(NOW_TICK2)} END", NOW_TICK2)}""")
QUERIES["due_retries"] = q(RETRY_LOG, f"""
SELECT event_id, due_s, original_topic FROM ({_due(NOW_DUE)})""")
QUERIES["release_due_once"] = q(RETRY_LOG, f"""
SELECT event_id, due_s, original_topic FROM {_not_first(_due(NOW_TICK2))}""")
QUERIES["expire_schedules"] = q(RETRY_LOG, f"""
SELECT event_id, due_s, scheduled_at_us, 'retry payload expired before release' AS reason
FROM {_not_first(f"SELECT *, ts_us AS scheduled_at_us, CASE WHEN next_retry_zero THEN -62135596800 ELSE CAST(floor(next_retry_after_us / 1000000) AS BIGINT) END AS due_s FROM " + _as_of(NOW_TICK2))}
WHERE {_us(NOW_TICK2)} >= scheduled_at_us + 86400000000""")
QUERIES["reschedule_failed"] = q(RETRY_LOG, f"""
SELECT event_id, CAST(floor((epoch_us(TIMESTAMPTZ '{NOW_DUE}') + 15000000) / 1000000) AS BIGINT) AS due_s,
       epoch_us(TIMESTAMPTZ '{NOW_DUE}') + 15000000 AS next_retry_after_us
FROM ({_due(NOW_DUE)}) WHERE CAST(substr(event_id, 2) AS BIGINT) % 17 = 0""")
QUERIES["ordered_by_affinity"] = q(HANDLED, f"""
SELECT {IDS}, affinity_key,
  row_number() OVER (PARTITION BY topic, affinity_key ORDER BY clock_us, topic, partition, "offset") AS seq
FROM handled WHERE routed""")

QUERIES["ordered_stream"] = QUERIES["ordered_by_affinity"].replace(" AS seq", " AS seq, seq AS handled")

AS_OF, LAST_FLUSH = "2024-01-15 12:00:00+00", "2024-01-15 11:00:00+00"


def _progress(as_of: str) -> str:
    return (f"(SELECT {IDS}, (epoch_us(\"timestamp\") + CAST(duration_s * 60 * 1000000 AS BIGINT)) "
            f"<= epoch_us(TIMESTAMPTZ '{as_of}') AS completed FROM msgs "
            f"WHERE epoch_us(\"timestamp\") <= epoch_us(TIMESTAMPTZ '{as_of}'))")


def _frontier(as_of: str) -> str:
    return (f"(SELECT topic, partition, first_offset, coalesce(first_open - 1, last_offset) AS committable FROM "
            f"(SELECT topic, partition, min(\"offset\") AS first_offset, max(\"offset\") AS last_offset, "
            f"min(\"offset\") FILTER (WHERE NOT completed) AS first_open FROM {_progress(as_of)} GROUP BY ALL) "
            f"WHERE coalesce(first_open - 1, last_offset) >= first_offset)")


QUERIES["committable_offsets"] = q("", f"SELECT * FROM {_frontier(AS_OF)}")
QUERIES["committable_offsets_strict"] = q("", f"""
SELECT topic, partition, first_offset, committable FROM (
  SELECT topic, partition, first_offset,
         coalesce(first_offset + min(rn) FILTER (WHERE NOT good) - 2, max("offset")) AS committable
  FROM (SELECT *, completed AND ("offset" - rn = first_offset - 1) AS good FROM (
          SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY "offset") AS rn,
                 min("offset") OVER (PARTITION BY topic, partition) AS first_offset
          FROM {_progress(AS_OF)}))
  GROUP BY topic, partition, first_offset)
WHERE committable >= first_offset""")
QUERIES["newly_committable"] = q("", f"""
SELECT c.topic, c.partition, c.committable, l.committable AS last_committed
FROM {_frontier(AS_OF)} c LEFT JOIN {_frontier(LAST_FLUSH)} l ON c.topic = l.topic AND c.partition = l.partition
WHERE l.committable IS NULL OR c.committable > l.committable""")
QUERIES["in_flight"] = q("", f"""
SELECT topic, partition, count(*) AS tracked, count(*) FILTER (WHERE NOT completed) AS in_flight
FROM {_progress(AS_OF)} GROUP BY ALL""")
QUERIES["consumer_lag"] = q("", f"""
SELECT g.topic, g.partition, g.last_offset - coalesce(c.committable, g.first_offset - 1) AS lag
FROM (SELECT topic, partition, min("offset") AS first_offset, max("offset") AS last_offset
      FROM {_progress(AS_OF)} GROUP BY ALL) g
LEFT JOIN {_frontier(AS_OF)} c ON c.topic = g.topic AND c.partition = g.partition""")

# ---------------------------------------------------------------- metrics ---
QUERIES["messages_received"] = q(TRIAGED, """
SELECT topic, tenant_id, count(*) AS n FROM classified WHERE routed GROUP BY ALL""")
QUERIES["messages_processed"] = q(TRIAGED, f"""
SELECT topic, event_type, tenant_id, count(*) AS n FROM {RAN} AND error IS NULL GROUP BY ALL""")
QUERIES["messages_failed"] = q(TRIAGED, f"""
SELECT topic, event_type, tenant_id, reason, count(*) AS n FROM (
  SELECT topic, event_type, tenant_id, 'processing_error' AS reason FROM {RAN} AND error IS NOT NULL
  UNION ALL
  SELECT topic, event_type, tenant_id, 'panic' FROM {RAN} AND error_class = 'panic') GROUP BY ALL""")
QUERIES["messages_retried"] = q(TRIAGED, """
SELECT topic, event_type, tenant_id, count(*) AS n FROM classified WHERE outcome = 'retry' GROUP BY ALL""")
QUERIES["messages_dlq"] = q(TRIAGED, """
SELECT topic, event_type, tenant_id, count(*) AS n FROM classified
WHERE outcome = 'dlq' AND dlq_kind = 'event' GROUP BY ALL""")
_LES = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0"]
QUERIES["processing_duration"] = q(TRIAGED, f"""
SELECT topic, event_type, processor, b.le, b.bucket_count, total_count, total_sum FROM (
  SELECT topic, event_type, processor, count(*) AS total_count, round(sum(duration_s), 6) AS total_sum,
    [{", ".join(f"{{'le': '{le}', 'bucket_count': count(*) FILTER (WHERE duration_s <= {le})}}" for le in _LES)},
     {{'le': '+Inf', 'bucket_count': count(*)}}] AS bs
  FROM {RAN} GROUP BY ALL) t, unnest(t.bs) AS u(b)""")
QUERIES["lane_load"] = q(TRIAGED, """
SELECT topic, lane, sum(c) AS n, count(*) AS keys, max({'c': c, 'k': affinity_key}).k AS top_key,
       max({'c': c, 'k': affinity_key}).c AS top_key_n
FROM (SELECT topic, lane, affinity_key, count(*) AS c FROM classified WHERE routed GROUP BY ALL) GROUP BY ALL""")
SAFE = HANDLED.replace("handled AS (SELECT *,", "handled_native AS (SELECT *,") + r"""
handled AS (SELECT * REPLACE (
    CASE WHEN processor = 'VISIT_APPROVED' THEN CASE WHEN fault = 'panic' THEN 'panic' END
         WHEN notif_err IS NOT NULL THEN 'business_validation' END AS error_class,
    CASE WHEN processor = 'VISIT_APPROVED' THEN CASE WHEN fault = 'panic' THEN 'panic: simulated handler panic' END
         WHEN notif_err IS NOT NULL THEN 'business validation: invalid NOTIFICATION_TRIGGERED data: ' || notif_err END AS error)
  FROM handled_native),
"""
QUERIES["safe_handler"] = q(SAFE + _fold("error IS NULL"), f"""
SELECT {IDS}, processor, dedup_status, CASE WHEN dedup_status = 'claimed' THEN error_class END AS error_class,
  CASE WHEN dedup_status = 'claimed' THEN error END AS error FROM dedup WHERE routed""")

_NO = "CAST(NULL AS VARCHAR)"
QUERIES["stream_counters"] = q(STREAMED + """,
ran AS (SELECT * FROM classified WHERE routed AND dedup_status = 'claimed')""", f"""
SELECT metric, topic, event_type, tenant_id, processor, label, count(*) AS n, round(sum(d), 6) AS total FROM (
  SELECT 'messages_received' AS metric, topic, {_NO} AS event_type, tenant_id, {_NO} AS processor, {_NO} AS label, CAST(NULL AS DOUBLE) AS d FROM classified WHERE routed
  UNION ALL SELECT 'messages_processed', topic, event_type, tenant_id, NULL, NULL, NULL FROM ran WHERE error IS NULL
  UNION ALL SELECT 'messages_failed', topic, event_type, tenant_id, NULL, 'processing_error', NULL FROM ran WHERE error IS NOT NULL
  UNION ALL SELECT 'messages_failed', topic, event_type, tenant_id, NULL, 'panic', NULL FROM ran WHERE error IS NOT NULL AND error_class = 'panic'
  UNION ALL SELECT 'messages_retried', topic, event_type, tenant_id, NULL, NULL, NULL FROM classified WHERE outcome = 'retry'
  UNION ALL SELECT 'messages_dlq', topic, event_type, tenant_id, NULL, NULL, NULL FROM classified WHERE outcome = 'dlq' AND dlq_kind = 'event'
  UNION ALL SELECT 'processing_duration', topic, event_type, NULL, processor,
    CASE {" ".join(f"WHEN duration_s <= {le} THEN '{le}'" for le in _LES)} ELSE '+Inf' END, duration_s FROM ran WHERE duration_s IS NOT NULL)
GROUP BY ALL""")
QUERIES["frontier_stream"] = q("", f"""
SELECT i.topic, i.partition, g.first_offset, c.committable, s.committable AS committable_strict, i.tracked, i.in_flight,
       g.last_offset - coalesce(c.committable, g.first_offset - 1) AS lag
FROM (SELECT topic, partition, count(*) AS tracked, count(*) FILTER (WHERE NOT completed) AS in_flight FROM {_progress(AS_OF)} GROUP BY ALL) i
JOIN (SELECT topic, partition, min("offset") AS first_offset, max("offset") AS last_offset FROM {_progress(AS_OF)} GROUP BY ALL) g USING (topic, partition)
LEFT JOIN {_frontier(AS_OF)} c USING (topic, partition)
LEFT JOIN ({QUERIES["committable_offsets_strict"][QUERIES["committable_offsets_strict"].index("SELECT topic, partition, first_offset, committable"):]}) s USING (topic, partition)""")

QUERIES["check_registry_unique"] = q(PARSED, """
SELECT event_type, version, count(DISTINCT t) AS n FROM (
  SELECT event_type, version, unnest([min(topic), max(topic)]) AS t FROM resolved WHERE envelope_error IS NULL GROUP BY event_type, version)
GROUP BY event_type, version HAVING count(DISTINCT t) > 1""")
QUERIES["hot_keys"] = q(TRIAGED, """
SELECT topic, affinity_key, n, rank FROM (
  SELECT topic, affinity_key, count(*) AS n, CAST(row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, affinity_key) AS INTEGER) AS rank
  FROM classified WHERE routed GROUP BY topic, affinity_key) WHERE rank <= 5""")
