"""Retry scheduling on batch tables: one timeline of an id's schedules, the table as of a time, due
selection, release-once, payload expiry and republish-failure rescheduling.

A schedule ends once: it is released by the first tick at or after its due time, or replaced by the
id's next schedule if that comes no later, or expired once its payload is 24 h old if that comes first. A due time of
zero is never reached. Every operator takes the clock as a column.

The timeline needs each schedule's successor only. Ranks within an id come from the skew-safe scan (``rank_within``) and the
successor from a join on (id, rank), so an id with a third of all schedules is spread over tasks. Positions
and times alone take part; payloads are joined to the few rows asked for (``with_payload``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import constants as K
from sluice.functions.clock import add_seconds
from sluice.operators.scan import rank_within

# A zero time (JSON null / absent nextRetryAfter) has this epoch second: never due.
ZERO_TIME_EPOCH_S = -62135596800
POSITION = ["topic", "partition", "offset"]
PAYLOAD = ["original_topic", "version", "event_type", "tenant_id", "event_ts", "data_json", "retry_count", "failure_reason", "first_failure_time"]
RELEASED, REPLACED, EXPIRED, PENDING = "released", "replaced", "expired", "pending"


def _due_s() -> Column:
    return F.when(F.col("next_retry_zero"), F.lit(ZERO_TIME_EPOCH_S)).otherwise(
        F.floor(F.unix_micros(F.col("next_retry_after")) / 1_000_000)).cast("bigint")


def retry_timeline(parsed_retry: DataFrame, now: Column, ticks: Sequence[Column] | None = None,
                   clock_col: str = "timestamp", ttl_s: int = K.RETRY_PAYLOAD_TTL_S) -> DataFrame:
    """Every schedule up to ``now`` with its end: event_id, seq, due_s, scheduled_at, position, end, ended_at.

    ``ticks`` are the times at which due schedules are released (ascending); without them every whole second is one.
    ``end`` is released, replaced, expired or pending (at ``now``; ``ended_at`` NULL).
    """
    ok = parsed_retry.where(F.col("retry_error").isNull() & (F.col(clock_col) <= now)) \
        .select("event_id", _due_s().alias("due_s"), F.col(clock_col).alias("scheduled_at"), *POSITION)
    from sluice.session import materialize
    ok = materialize(ok, "retry-ok")  # the ranking reads its rows twice: they are parsed once
    ranked = materialize(rank_within(ok, ["event_id"], ["scheduled_at", *POSITION], out="seq"), "retry-ranked")
    later = ranked.select("event_id", (F.col("seq") - 1).alias("seq"), F.col("scheduled_at").alias("_next"))
    t = ranked.join(later, ["event_id", "seq"], "left")
    us = F.unix_micros
    ready = F.when(F.col("due_s") >= 0, F.greatest(F.col("due_s") * 1_000_000, us("scheduled_at")))
    if ticks is None:
        release = F.ceil(ready / 1_000_000) * 1_000_000
    else:
        release = F.array_min(F.filter(F.array(*[us(x) for x in ticks]), lambda x: x >= ready))
    t = t.withColumns({"_release": release.cast("bigint"), "_expiry": us("scheduled_at") + ttl_s * 1_000_000, "_next": us("_next")})
    # NULL stands for never; a tie goes to the replacement, then to the expiry
    first = F.least("_release", "_expiry", "_next", us(now))
    end = (F.when(F.col("_next") == first, REPLACED).when(F.col("_expiry") == first, EXPIRED)
           .when(F.col("_release") == first, RELEASED).otherwise(PENDING))
    return t.withColumn("end", end).select("event_id", "seq", "due_s", "scheduled_at", *POSITION, "end",
                                           F.when(F.col("end") != PENDING, F.timestamp_micros(first)).alias("ended_at"))


def with_payload(entries: DataFrame, parsed_retry: DataFrame) -> DataFrame:
    """The envelope fields of the records that ``entries`` name by position, for republishing."""
    return entries.join(parsed_retry.select(*POSITION, *PAYLOAD), POSITION)


def schedule_retries(parsed_retry: DataFrame, now: Column | None = None, clock_col: str = "timestamp") -> DataFrame:
    """The table that schedules up to ``now`` leave if nothing is released: the latest valid envelope per event id.

    Output: event_id, due_s (epoch seconds of nextRetryAfter), scheduled_at, position. One aggregate with map-side combine over positions.
    """
    ok = parsed_retry.where(F.col("retry_error").isNull())
    if now is not None:
        ok = ok.where(F.col(clock_col) <= now)
    rec = F.struct(_due_s().alias("due_s"), F.col(clock_col).alias("scheduled_at"), *POSITION)
    order = F.struct(F.col(clock_col), *POSITION)
    return ok.groupBy("event_id").agg(F.max_by(rec, order).alias("s")).select("event_id", "s.*")


def _alive(now: Column, ttl_s: int) -> Column:
    return now < add_seconds(F.col("scheduled_at"), F.lit(ttl_s))


def due_retries(schedule: DataFrame, now: Column, limit: int | None = None, ttl_s: int = K.RETRY_PAYLOAD_TTL_S) -> DataFrame:
    """All entries with 0 <= due_s <= now whose payload has not expired, oldest first with ``limit``.

    ``limit`` is for callers that poll (``DUE_BATCH_LIMIT`` a tick): the first entries by due time, then id (top-k, no full
    sort). Ticks repeated until nothing is due give the same entries as no limit.
    """
    now_s = F.floor(F.unix_micros(now) / 1_000_000)
    d = schedule.where((F.col("due_s") >= 0) & (F.col("due_s") <= now_s) & _alive(now, ttl_s))
    return d.orderBy("due_s", "event_id").limit(limit) if limit else d


def release_due_once(schedule: DataFrame, released: DataFrame, now: Column, limit: int | None = None,
                     ttl_s: int = K.RETRY_PAYLOAD_TTL_S) -> DataFrame:
    """Due entries that no earlier tick released; ``released`` names them by event_id and scheduled_at, so an id scheduled anew leaves again."""
    return due_retries(_pending(schedule, released), now, limit, ttl_s)


def _pending(schedule: DataFrame, released: DataFrame) -> DataFrame:
    return schedule.join(released.select("event_id", "scheduled_at").distinct(), ["event_id", "scheduled_at"], "left_anti")


def expire_schedules(schedule: DataFrame, released: DataFrame, now: Column,
                     ttl_s: int = K.RETRY_PAYLOAD_TTL_S) -> DataFrame:
    """Entries whose payload outlived its TTL before release: the retry is lost (side output). None of them is ever due."""
    return _pending(schedule, released).where(~_alive(now, ttl_s)) \
        .withColumn("reason", F.lit("retry payload expired before release"))


def reschedule_failed(republished: DataFrame, failed: Column, now: Column,
                      delay_s: int = K.REPUBLISH_FAILURE_DELAY_S) -> DataFrame:
    """A republish that failed is scheduled again ``delay_s`` after ``now``, with a payload life of its own."""
    nxt = add_seconds(now, F.lit(delay_s))
    return republished.where(failed).withColumns({
        "next_retry_after": nxt, "scheduled_at": now,
        "due_s": F.floor(F.unix_micros(nxt) / 1_000_000).cast("bigint")})
