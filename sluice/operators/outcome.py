"""Outcome classification, retry arithmetic and the sink record builders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import constants as K
from sluice.functions import strict_json as J
from sluice.functions.clock import add_seconds, backoff_seconds, format_rfc3339
from sluice.operators.parse import data_json


def is_retriable(error_class: Column) -> Column:
    """Final errors (bad envelope, business validation) are not retried; any other error is."""
    return error_class.isNotNull() & ~error_class.isin(K.EC_INVALID, K.EC_BUSINESS, K.EC_UNKNOWN,
                                                        K.EC_UNROUTED)


def should_retry(retry_count: Column, max_retries: int = K.MAX_RETRIES) -> Column:
    return retry_count < F.lit(max_retries)


def derived_topic(topic: Column, suffix: str) -> Column:
    return F.concat(topic, F.lit(suffix))


def classify_outcome(df: DataFrame, max_retries: int = K.MAX_RETRIES) -> DataFrame:
    """One outcome per message: processed / duplicate / retry / dlq (+ reason, sink topic).

    Expects ``envelope_error``, ``processor``, ``lanes``, ``dedup_status``,
    ``error_class``, ``error``, ``retry_count`` (rows of main topics).
    """
    final_reason = (F.when(F.col("envelope_error").isNotNull(), F.col("envelope_error"))
                    .when(F.col("processor").isNull(), F.concat(
                        F.lit(K.UNKNOWN_TYPE), F.col("event_type"), F.lit(" v"),
                        F.col("version").cast("string")))
                    .when(F.col("lanes").isNull(), F.lit(K.NO_POOL)))
    retry = is_retriable(F.col("error_class")) & should_retry(F.col("retry_count"), max_retries)
    outcome = (F.when(final_reason.isNotNull(), F.lit(K.DLQ))
               .when(F.col("dedup_status") == "duplicate", F.lit(K.DUPLICATE))
               .when(F.col("error").isNull(), F.lit(K.PROCESSED))
               .when(retry, F.lit(K.RETRY)).otherwise(F.lit(K.DLQ)))
    reason = F.coalesce(final_reason, F.when(outcome.isin(K.RETRY, K.DLQ), F.col("error")))
    sink = (F.when(outcome == K.RETRY, derived_topic(F.col("topic"), K.RETRY_SUFFIX))
            .when(outcome == K.DLQ, derived_topic(F.col("topic"), K.DLQ_SUFFIX)))
    dlq_kind = (F.when(F.col("envelope_error").isNotNull(), F.lit("raw"))
                .when(outcome == K.DLQ, F.lit("event")))
    return df.withColumns({"outcome": outcome, "reason": reason, "sink_topic": sink,
                           "dlq_kind": dlq_kind})


def next_retry_after(df: DataFrame, clock_col: str = "clock") -> DataFrame:
    """retry_count+1, its backoff (clamped both ends) and the due time."""
    n = F.col("retry_count") + 1
    return df.withColumns({
        "retry_count_next": n,
        "backoff_s": backoff_seconds(n),
        "next_retry_after": add_seconds(F.col(clock_col), backoff_seconds(n)),
    })


def carry_failure_history(df: DataFrame, clock_col: str = "clock") -> DataFrame:
    """First failure kept (or now), last failure = now, reason replaced by the new error."""
    return df.withColumns({
        "first_failure_next": F.coalesce(F.col("first_failure_time"), F.col(clock_col)),
        "last_failure_time": F.col(clock_col),
        "failure_reason_next": F.col("error"),
    })


# --------------------------------------------------------------- records ----
def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """Compact JSON object text from (key, JSON-text column) pairs, in the given order."""
    parts = []
    for i, (k, v) in enumerate(pairs):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{k}":'), F.coalesce(v, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def jnum(c: Column) -> Column:
    return c.cast("string")


def jtime(c: Column) -> Column:
    """A time as JSON; the zero time when NULL (how a typed encoder writes an unset time)."""
    return F.coalesce(J.json_string(format_rfc3339(c)), F.lit('"0001-01-01T00:00:00Z"'))


def payload_json(value_str: Column, is_json: Column) -> Column:
    """The original message as JSON: embedded (compacted) when it is one JSON value, else as a string.

    (A typed encoder fails on non-JSON raw bytes and the record is lost; keeping
    it as a string is a deliberate improvement.)
    """
    return F.when(is_json, J.compact_json(value_str)) \
        .otherwise(J.json_string(value_str))


def to_raw_dlq_record(df: DataFrame, clock_col: str = "clock") -> DataFrame:
    """Unparseable message -> dead-letter record; ids empty, retryCount 0, key = original key."""
    v = F.col("value_str")
    rec = json_object([
        ("originalPayload", payload_json(v, F.col("value_is_json"))), ("topic", J.json_string(F.col("topic"))),
        ("partition", jnum(F.col("partition"))), ("offset", jnum(F.col("offset"))),
        ("eventType", F.lit('""')), ("tenantId", F.lit('""')), ("eventId", F.lit('""')),
        ("failureReason", J.json_string(F.col("reason"))), ("retryCount", F.lit("0")),
        ("timestamp", jtime(F.col(clock_col)))])
    return df.withColumns({"sink_key": F.col("key").cast("string"), "sink_value": rec,
                           "payload_is_json": F.col("value_is_json")})


def to_dlq_record(df: DataFrame, clock_col: str = "clock") -> DataFrame:
    """Parsed event -> dead-letter record keyed by tenant."""
    # unknown type and unrouted topic dead-letter with retryCount 0; final failures keep theirs
    rc = F.when(F.col("processor").isNull() | F.col("lanes").isNull(), F.lit(0)) \
        .otherwise(F.col("retry_count"))
    rec = json_object([
        ("originalPayload", payload_json(F.col("value_str"), F.col("value_is_json"))), ("topic", J.json_string(F.col("topic"))),
        ("partition", jnum(F.col("partition"))), ("offset", jnum(F.col("offset"))),
        ("eventType", J.json_string(F.col("event_type"))), ("tenantId", J.json_string(F.col("tenant_id"))),
        ("eventId", J.json_string(F.col("event_id"))), ("failureReason", J.json_string(F.col("reason"))),
        ("retryCount", jnum(rc)), ("timestamp", jtime(F.col(clock_col)))])
    return df.withColumns({"sink_key": F.col("tenant_id"), "sink_value": rec,
                           "payload_is_json": F.col("value_is_json")})


def _event_fields(data: Column) -> list[tuple[str, Column]]:
    return [("version", jnum(F.col("version"))), ("eventId", J.json_string(F.col("event_id"))),
            ("eventType", J.json_string(F.col("event_type"))),
            ("tenantId", J.json_string(F.col("tenant_id"))), ("timestamp", jtime(F.col("event_ts"))),
            ("data", data)]


def to_retry_envelope(df: DataFrame, clock_col: str = "clock") -> DataFrame:
    """Failed, retriable event -> ``<topic>.retry`` envelope with carried failure history.

    The payload's text is cut from ``value_str`` here, for these records alone.
    """
    found = F.try_element_at(F.filter(J.members(F.col("value_str")), lambda m: m["key"] == "data"), F.lit(-1))
    data = F.transform(F.array(found), lambda m: data_json(F.col("value_str"), m["value"], m["kind"]))[0]
    d = carry_failure_history(next_retry_after(df, clock_col), clock_col)
    rec = json_object(_event_fields(data) + [
        ("originalTopic", J.json_string(F.col("topic"))), ("retryCount", jnum(F.col("retry_count_next"))),
        ("failureReason", J.json_string(F.col("failure_reason_next"))),
        ("firstFailureTime", jtime(F.col("first_failure_next"))),
        ("lastFailureTime", jtime(F.col("last_failure_time"))),
        ("nextRetryAfter", jtime(F.col("next_retry_after")))])
    return d.withColumns({"sink_key": F.col("tenant_id"), "sink_value": rec})


def to_republish_envelope(df: DataFrame) -> DataFrame:
    """Due retry -> normal envelope on its original topic, carrying retryCount and failure history."""
    rec = json_object(_event_fields(F.col("data_json")) + [
        ("retryCount", jnum(F.col("retry_count"))),
        ("failureReason", J.json_string(F.col("failure_reason"))),
        ("firstFailureTime", jtime(F.col("first_failure_time")))])
    return df.withColumns({"sink_topic": F.col("original_topic"), "sink_key": F.col("tenant_id"),
                           "sink_value": rec})
