"""Envelope parsing and validation (narrow, codegen'd expressions; no Python rows).

The JSON text is decoded once, to its members in document order: VARIANT values keep each
one's JSON type so a typed-decoder's strictness can be reproduced, names match without case and the
last one wins; a second parse rejects trailing text and other malformed input. The payload's text is
cut out only where a record leaves with it (``payload_text``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import constants as K
from sluice.functions import strict_json as J
from sluice.functions.clock import parse_rfc3339
from sluice.session import keep_methods_compiled

ENVELOPE_FIELDS = (  # (json name, decoded type) in declaration order
    ("version", "int"), ("eventId", "string"), ("eventType", "string"), ("tenantId", "string"),
    ("timestamp", "string"), ("data", "raw"), ("retryCount", "int"),
    ("failureReason", "string"), ("firstFailureTime", "string"))

RETRY_FIELDS = (
    ("version", "int"), ("eventId", "string"), ("eventType", "string"), ("tenantId", "string"),
    ("timestamp", "time"), ("data", "raw"), ("originalTopic", "string"), ("retryCount", "int"),
    ("failureReason", "string"), ("firstFailureTime", "time"), ("lastFailureTime", "time"),
    ("nextRetryAfter", "time"))


def _str(m: Column) -> Column:
    """Decoded string field: the string, or '' for null / absent (zero value)."""
    return F.coalesce(F.when(m["kind"] == "string", F.variant_get(m["value"], "$", "string")), F.lit(""))


def _int(m: Column) -> Column:
    return F.coalesce(F.when(m["kind"] == "int", F.try_variant_get(m["value"], "$", "bigint")), F.lit(0))


def _member_error(m: Column, fields, struct_name: str) -> Column:
    """Error text of one member, NULL if it fits its field, is null or belongs to none."""
    out = F.lit(None).cast("string")
    for name, typ in fields:
        if typ == "time":
            text = F.variant_get(m["value"], "$", "string")
            bad = (F.when(m["kind"] == "null", F.lit(None))
                   .when(m["kind"] != "string", F.lit("Time.UnmarshalJSON: input is not a JSON string"))
                   .when(parse_rfc3339(text).isNull(), F.concat(F.lit('parsing time "'), text, F.lit('": not RFC 3339'))))
        elif typ in ("int", "string"):
            bad = J.field_type_error(m["value"], struct_name, name, typ, kind=m["kind"])
        else:
            continue
        out = F.when(m["key"] == name.lower(), bad).otherwise(out)
    return out


def data_json(text: Column, data: Column, kind: Column) -> Column:
    """Compact JSON text of the ``data`` member, its literals as written.

    (A member whose name is written with escapes is rendered from the decoded value.)
    """
    return (F.when(kind.isNull(), F.lit(None))
            .when(kind == "null", F.lit("null"))
            .otherwise(F.coalesce(J.member_json(text, "data", kind), F.to_json(data))))


def _decode(df: DataFrame, text: Column, fields, struct_name: str, go_type: str) -> DataFrame:
    """Adds ``_f_<field>`` (value VARIANT, kind), ``_p_<field>`` (a time's instant), ``decode_error`` and ``value_is_json``.

    Names match without case and the last member of a name counts, but a null leaves what an earlier one set (``data``
    takes it). The first member that does not fit its field, in document order, is the error. An object without repeated
    names has one member a field at most, found by position; the members are gone through only where names repeat or a field
    does not fit.
    """
    keep_methods_compiled(df.sparkSession)
    # a repeated key inside a value keeps its last one, as in a typed decoder (the setting's default is an error, read as NULL)
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = df.withColumn("_m", J.computed_once(J.members(text)))
    m = F.col("_m")
    df = df.withColumns({"value_is_json": J.computed_once(J.is_only_value(text, m)), "_keys": J.computed_once(m["key"]),
                         "_once": J.computed_once(F.size(F.array_distinct(m["key"])) == F.size(m))})

    def last(name: str, typ: str) -> Column:
        mine = F.filter(m, lambda x: (x["key"] == name.lower()) & (F.lit(typ == "raw") | (x["kind"] != "null")))
        only = F.get(m, (F.array_position("_keys", name.lower()) - 1).cast("int"))
        return F.when(F.col("_once"), F.when(F.lit(typ == "raw") | (only["kind"] != "null"), only)).otherwise(F.try_element_at(mine, F.lit(-1)))
    df = df.withColumns({f"_f_{n}": J.computed_once(F.when(F.size(m) > 0, last(n, t))) for n, t in fields})
    times = [n for n, t in fields if t == "time"]
    df = df.withColumns({f"_p_{n}": J.computed_once(F.when(F.col(f"_f_{n}.kind") == "string", parse_rfc3339(
        F.variant_get(F.col(f"_f_{n}.value"), "$", "string")))) for n in times})
    unfit = ~F.col("_once")
    for n, t in fields:
        if t != "raw":
            unfit = unfit | F.coalesce(F.col(f"_f_{n}.kind") != ("int" if t == "int" else "string"), F.lit(False))
        if t == "time":
            unfit = unfit | (F.col(f"_f_{n}").isNotNull() & F.col(f"_p_{n}").isNull())
    errors = F.filter(F.transform(m, lambda x: _member_error(x, fields, struct_name)), lambda e: e.isNotNull())
    syntax = (F.when(F.trim(text) == "", F.lit("unexpected end of JSON input")).when(~F.col("value_is_json"), F.lit("malformed JSON")))
    err = F.coalesce(syntax, J.value_type_error(J.top_level_kind(text), go_type), F.when(unfit, F.get(errors, F.lit(0))))
    return df.withColumn("decode_error", J.computed_once(err)).drop("_keys", "_once")


def _text(raw: DataFrame, value_col: str) -> DataFrame:
    return raw.withColumn("value_str", F.coalesce(F.col(value_col).cast("string"), F.lit("")))


def parse_envelope(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Decode the envelope of every record.

    Adds ``value_str``, ``value_is_json``, ``decode_error`` (NULL when the JSON decodes),
    ``version, event_id, event_type, tenant_id, timestamp_str, has_data, data
    (VARIANT), data_kind, retry_count, failure_reason, first_failure_str``. A null value is empty text.
    """
    df = _text(raw, value_col)
    df = _decode(df, F.col("value_str"), ENVELOPE_FIELDS, K.ENVELOPE_STRUCT, K.ENVELOPE_TYPE)
    ok = F.col("decode_error").isNull()
    # a decode error yields the zero event: every field empty
    f = {n: F.when(ok, F.col(f"_f_{n}")) for n, _ in ENVELOPE_FIELDS}
    return (df.withColumns({
        "version": _int(f["version"]), "event_id": _str(f["eventId"]), "event_type": _str(f["eventType"]),
        "tenant_id": _str(f["tenantId"]), "timestamp_str": _str(f["timestamp"]),
        "has_data": F.coalesce(f["data"]["kind"].isNotNull(), F.lit(False)),
        "data": f["data"]["value"], "data_kind": f["data"]["kind"],
        "retry_count": _int(f["retryCount"]), "failure_reason": _str(f["failureReason"]),
        "first_failure_str": _str(f["firstFailureTime"]),
    }).drop("_m", *[f"_f_{n}" for n, _ in ENVELOPE_FIELDS]))


def payload_text(parsed: DataFrame) -> DataFrame:
    """``data_json``: the payload's text, for the few records that leave with it."""
    return parsed.withColumn("data_json", data_json(F.col("value_str"), F.col("data"), F.col("data_kind")))


def validate_envelope(parsed: DataFrame) -> DataFrame:
    """Mandatory-field checks in fixed order; first failure is the reason.

    Adds ``envelope_error`` (full reason text or NULL), ``event_ts`` (strict
    RFC 3339 instant) and ``first_failure_time`` (lenient: bad text -> NULL).
    """
    parsed = parsed.withColumn("event_ts", parse_rfc3339(F.col("timestamp_str")))
    ts = F.col("event_ts")
    inv = F.lit(K.INVALID_ENVELOPE)
    reason = (F.when(F.col("decode_error").isNotNull(),
                     F.concat(inv, F.lit(K.JSON_UNMARSHAL), F.col("decode_error")))
              .when(F.col("version") == 0, F.concat(inv, F.lit(K.MISSING_VERSION)))
              .when(F.col("event_id") == "", F.concat(inv, F.lit(K.MISSING_EVENT_ID)))
              .when(F.col("event_type") == "", F.concat(inv, F.lit(K.MISSING_EVENT_TYPE)))
              .when(F.col("tenant_id") == "", F.concat(inv, F.lit(K.MISSING_TENANT_ID)))
              .when(F.col("timestamp_str") == "", F.concat(inv, F.lit(K.MISSING_TIMESTAMP)))
              .when(~F.col("has_data"), F.concat(inv, F.lit(K.MISSING_DATA)))
              .when(ts.isNull(), F.concat(inv, F.lit(K.INVALID_TIMESTAMP), F.col("timestamp_str"))))
    ff = F.when(F.col("first_failure_str") != "", parse_rfc3339(F.col("first_failure_str")))
    return parsed.withColumns({"envelope_error": reason, "first_failure_time": ff})


def parse_and_validate(raw: DataFrame) -> DataFrame:
    return validate_envelope(parse_envelope(raw))


def invalid_envelopes(validated: DataFrame) -> DataFrame:
    """Rows whose envelope fails: they go to the raw dead-letter path."""
    return validated.where(F.col("envelope_error").isNotNull())


def parse_retry_metadata(validated: DataFrame) -> DataFrame:
    """The optional retry fields carried by a republished envelope."""
    return validated.select("topic", "partition", "offset", "retry_count", "failure_reason",
                            "first_failure_time")


def parse_retry_envelope(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Decode ``<topic>.retry`` records; ``retry_error`` is the dead-letter reason or NULL."""
    df = _text(raw, value_col)
    t = F.col("value_str")
    df = _decode(df, t, RETRY_FIELDS, K.RETRY_STRUCT, K.RETRY_TYPE)
    ok = F.col("decode_error").isNull()
    # a decode error yields the zero envelope
    f = {n: F.when(ok, F.col(f"_f_{n}")) for n, _ in RETRY_FIELDS}

    def tm(name):
        return F.when(ok, F.col(f"_p_{name}"))
    df = df.withColumns({
        "version": _int(f["version"]), "event_id": _str(f["eventId"]),
        "event_type": _str(f["eventType"]), "tenant_id": _str(f["tenantId"]),
        "event_ts": tm("timestamp"), "data_json": data_json(t, f["data"]["value"], f["data"]["kind"]),
        "original_topic": _str(f["originalTopic"]),
        "retry_count": _int(f["retryCount"]),
        "failure_reason": _str(f["failureReason"]),
        "first_failure_time": tm("firstFailureTime"),
        "last_failure_time": tm("lastFailureTime"), "next_retry_after": tm("nextRetryAfter"),
        # a time that is JSON null or absent is the zero time
        "next_retry_zero": f["nextRetryAfter"]["kind"].isNull(),
    }).drop("_m", *[f"_{c}_{n}" for n, _ in RETRY_FIELDS for c in "fp"])
    reason = (F.when(F.col("decode_error").isNotNull(),
                     F.concat(F.lit(K.INVALID_RETRY_ENVELOPE + K.UNMARSHAL_RETRY), F.col("decode_error")))
              .when((F.col("event_id") == "") | (F.col("original_topic") == ""),
                    F.lit(K.INVALID_RETRY_ENVELOPE + K.RETRY_MISSING_IDS)))
    return df.withColumn("retry_error", reason)


def invalid_retry_envelopes(parsed_retry: DataFrame) -> DataFrame:
    return parsed_retry.where(F.col("retry_error").isNotNull())


# ---------------------------------------------------------------- payloads ---
VISIT_FIELDS = ("visitId", "agentId", "caseId", "approvedAt")
NOTIFICATION_FIELDS = ("notificationId", "recipientId", "channel", "templateId")


def payload_error(data: Column, fields, struct_name: str, go_type: str) -> Column:
    """Decode error of a handler payload: non-object, or a listed field that is not a string."""
    k = F.col("data_kind")
    errs = [J.field_type_error(F.try_variant_get(data, f"$.{f}", "variant"), struct_name, f, "string")
            for f in fields]
    return F.coalesce(J.value_type_error(F.coalesce(k, F.lit("null")), go_type),
                      F.when(k == "object", F.coalesce(*errs)))


def _payload_str(data: Column, f: str) -> Column:
    v = F.try_variant_get(data, f"$.{f}", "variant")
    return F.when(J.variant_kind(v) == "string", F.variant_get(v, "$", "string"))


def parse_visit_approved(events: DataFrame) -> DataFrame:
    """VISIT_APPROVED payload fields + ``payload_error`` (business error text or NULL)."""
    d = F.col("data")
    err = payload_error(d, VISIT_FIELDS, K.VISIT_STRUCT, K.VISIT_TYPE)
    return events.withColumns({
        "visit_id": _payload_str(d, "visitId"), "agent_id": _payload_str(d, "agentId"),
        "case_id": _payload_str(d, "caseId"), "approved_at": _payload_str(d, "approvedAt"),
        "payload_error": F.when(err.isNotNull(), F.concat(
            F.lit(K.BUSINESS + "invalid VISIT_APPROVED data: "), err))})


def parse_notification_triggered(events: DataFrame) -> DataFrame:
    """NOTIFICATION_TRIGGERED payload fields (payload kept as JSON text) + ``payload_error``."""
    d = F.col("data")
    err = payload_error(d, NOTIFICATION_FIELDS, K.NOTIFICATION_STRUCT, K.NOTIFICATION_TYPE)
    pv = F.try_variant_get(d, "$.payload", "variant")
    return events.withColumns({
        "notification_id": _payload_str(d, "notificationId"),
        "recipient_id": _payload_str(d, "recipientId"), "channel": _payload_str(d, "channel"),
        "template_id": _payload_str(d, "templateId"),
        "payload_json": F.when(pv.isNotNull(), F.to_json(pv)),
        "payload_error": F.when(err.isNotNull(), F.concat(
            F.lit(K.BUSINESS + "invalid NOTIFICATION_TRIGGERED data: "), err))})


def affinity_key(events: DataFrame) -> DataFrame:
    """``tenant:caseId`` when the payload carries a non-empty string caseId, else ``tenant``."""
    d = F.col("data")
    case_v = F.try_variant_get(d, "$.caseId", "variant")
    case_id = F.when((F.col("data_kind") == "object") & (J.variant_kind(case_v) == "string"),
                     F.variant_get(case_v, "$", "string"))
    return events.withColumn("affinity_key", F.when(F.coalesce(case_id, F.lit("")) != "",
                                                     F.concat(F.col("tenant_id"), F.lit(":"), case_id))
                             .otherwise(F.col("tenant_id")))
