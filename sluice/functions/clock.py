"""Timestamp and backoff column functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice import constants as K

# --- fixed value: RFC 3339 shape (offset mandatory, fraction optional, after a point or comma) -------
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"


def parse_rfc3339(s: Column) -> Column:
    """Strict RFC 3339 -> TIMESTAMP (UTC instant), NULL when the text is not RFC 3339.

    The regex guard rejects dates without time, missing offsets and ``+0530``
    forms that the lenient cast would accept; the cast then rejects impossible
    dates. The offset is subtracted, as it may be more than the 18 hours that a cast knows (24 hours and
    60 minutes at most). Nanoseconds truncate to microseconds.
    """
    utc = s.endswith("Z")
    local = F.when(utc, s).otherwise(F.concat(F.substring(s, F.lit(1), F.length(s) - 6), F.lit("Z")))
    part = lambda at: F.substring(s, F.length(s) - at, F.lit(2)).try_cast("int")
    seconds = F.when(utc, F.lit(0)).otherwise(F.when(F.substring(s, F.length(s) - 5, F.lit(1)) == "-", F.lit(-1)).otherwise(F.lit(1)) * (part(4) * 3600 + part(1) * 60))
    near = utc | ((part(4) <= 24) & (part(1) <= 60))
    at = F.unix_micros(F.try_to_timestamp(F.translate(local, ",", ".")))
    return F.when(s.rlike(RFC3339_PATTERN) & near, F.timestamp_micros(at - seconds.cast("bigint") * 1_000_000))


def format_rfc3339(ts: Column) -> Column:
    """UTC instant -> RFC 3339 text with trailing fractional zeros trimmed."""
    txt = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    txt = F.regexp_replace(F.regexp_replace(txt, r"0+$", ""), r"\.$", "")
    return F.when(ts.isNotNull(), F.concat(txt, F.lit("Z")))


def backoff_seconds(retry_count_next: Column) -> Column:
    """Backoff for attempt n (1-based), clamped to the schedule on both ends."""
    arr = F.array(*[F.lit(s) for s in K.BACKOFF_SECONDS])
    idx = F.greatest(F.lit(1), F.least(retry_count_next.cast("int"), F.lit(len(K.BACKOFF_SECONDS))))
    return F.element_at(arr, idx).cast("bigint")


def add_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + secs.cast("bigint") * F.lit(1_000_000).cast("bigint"))
