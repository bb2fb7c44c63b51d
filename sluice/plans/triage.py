"""The whole chain for one batch (or micro-batch) of raw records.

main topics:  parse+validate -> resolve handler (broadcast lookup) -> route to a
              pool (broadcast lookup) -> affinity key / lane -> handler ->
              48 h claim with release -> outcome
retry topics: parse retry envelope -> scheduled | dead letter

Everything up to the handler is narrow (one stage, no shuffle). The claim fold
shuffles narrow rows (id, clock, position) only and is skew-safe (see ``operators.dedup``);
its duplicates are joined back, by broadcast below the session's byte threshold, else by a
shuffle of the prepared rows.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import constants as K
from sluice.functions.hashing import lane_of
from sluice.operators import dedup as D
from sluice.operators import handlers as H
from sluice.operators import outcome as O
from sluice.operators import parse as P
from sluice.operators import route as R
from sluice.operators.execute import run_claimed
from sluice.sources.messages import split_retry_topics

IDS = ["topic", "partition", "offset"]


def prepare(raw: DataFrame, registry: DataFrame, topics: DataFrame,
            handlers: Mapping[str, H.Handler] | None = None, fault_col: str | None = None,
            clock_col: str = "timestamp") -> DataFrame:
    """Everything before the claim fold: all narrow, plus two broadcast lookups."""
    R.check_registry_unique(registry)
    H.check_handlers(registry, handlers)
    v = P.parse_and_validate(raw).withColumn("clock", F.col(clock_col))
    v = R.resolve_processor(v, registry)
    v = R.route_topics(v, topics)
    v = P.affinity_key(v).withColumn("lane", lane_of(F.col("affinity_key"), F.col("lanes")))
    routed = F.col("envelope_error").isNull() & F.col("processor").isNotNull() & F.col("lanes").isNotNull()
    v = v.withColumn("routed", routed)
    v = H.apply_handlers(v, handlers, fault_col, where=F.col("routed"))
    return v.withColumns({"error_class": F.when(routed, F.col("error_class")),
                          "error": F.when(routed, F.col("error"))})


def run_triage(raw: DataFrame, registry: DataFrame, topics: DataFrame,
               handlers: Mapping[str, H.Handler] | None = None, fault_col: str | None = None,
               clock_col: str = "timestamp", max_retries: int = K.MAX_RETRIES,
               dedup: bool = True, prior_claims: DataFrame | None = None) -> DataFrame:
    """Classify every main-topic record into processed / duplicate / retry / dlq.

    ``prior_claims`` (from ``open_claims`` of the run before) carries the claim windows over runs.
    Python handlers run on claimed rows only.
    """
    from sluice.session import materialize
    main, _ = split_retry_topics(raw)
    native, python = H.split_python(handlers)
    v = prepare(main, registry, topics, native, fault_col, clock_col)
    if python:
        columns = list(dict.fromkeys(c for h in python.values() for c in h.check.columns))
        v = materialize(v.drop(*[c for c in ("data", "value") if c not in columns]), "prepared")
        v = run_claimed(v, {n: h.check.fn for n, h in python.items()}, columns, prior=prior_claims, dedup=dedup)
    elif dedup:
        # two passes over the prepared rows (narrow claim fold, then the join back):
        # write them once instead of parsing every record twice
        # (``value`` is the binary twin of ``value_str``: not written twice)
        v = materialize(v.drop("data", "value"), "prepared")
        v = D.dedup_release(v, clock="clock", where=F.col("routed"), prior=prior_claims)
    else:
        v = v.withColumn("dedup_status", F.when(F.col("routed"), F.lit(D.CLAIMED)))
    return O.classify_outcome(v, max_retries)


def triage_retry_topics(raw: DataFrame, clock_col: str = "timestamp") -> DataFrame:
    """``.retry`` records: 'scheduled' when the envelope decodes, else dead letter (raw)."""
    _, retry = split_retry_topics(raw)
    return dead_letter_retries(P.parse_retry_envelope(retry).withColumn("clock", F.col(clock_col)))


def dead_letter_retries(parsed: DataFrame) -> DataFrame:
    bad = F.col("retry_error").isNotNull()
    return parsed.withColumns({
        "outcome": F.when(bad, F.lit(K.DLQ)).otherwise(F.lit(K.SCHEDULED)),
        "reason": F.col("retry_error"),
        "sink_topic": F.when(bad, O.derived_topic(F.col("topic"), K.DLQ_SUFFIX)),
        "dlq_kind": F.when(bad, F.lit("raw"))})


def open_claims(triaged: DataFrame, now: Column, prior_claims: DataFrame | None = None) -> DataFrame:
    """The claims that a run of ``run_triage`` leaves open at ``now``: the next run's ``prior_claims``."""
    return D.open_claims(triaged, now, ok=F.col("error").isNull(), prior=prior_claims)


OUTCOME_COLUMNS = ["topic", "partition", "offset", "event_id", "event_type", "tenant_id", "outcome",
                   "reason", "sink_topic"]


def triage_log(raw: DataFrame, registry: DataFrame, topics: DataFrame, **kw) -> DataFrame:
    """Main and retry topics together: every record gets exactly one outcome."""
    clock_col = kw.get("clock_col", "timestamp")
    a = run_triage(raw, registry, topics, **kw).select(*OUTCOME_COLUMNS)
    b = triage_retry_topics(raw, clock_col).select(*OUTCOME_COLUMNS)
    return a.unionByName(b)


def sink_records(triaged: DataFrame) -> DataFrame:
    """(sink_topic, sink_key, sink_value) for every record leaving to a retry or dead-letter topic.

    One pass: the three record builders are projected side by side and a CASE
    on the outcome picks one (each builder is referenced once, so Catalyst
    inlines it into its CASE branch and only the chosen record is built).
    """
    t = triaged.where(F.col("outcome").isin(K.RETRY, K.DLQ))
    t = O.to_raw_dlq_record(t).withColumnsRenamed({"sink_key": "_raw_k", "sink_value": "_raw_v"})
    t = O.to_dlq_record(t.drop("payload_is_json")).withColumnsRenamed(
        {"sink_key": "_ev_k", "sink_value": "_ev_v"}).drop("payload_is_json")
    t = O.to_retry_envelope(t)
    kind = F.col("dlq_kind")
    return t.select(
        *IDS, "outcome", "sink_topic",
        F.when(kind == "raw", F.col("_raw_k")).when(kind == "event", F.col("_ev_k"))
        .otherwise(F.col("sink_key")).alias("sink_key"),
        F.when(kind == "raw", F.col("_raw_v")).when(kind == "event", F.col("_ev_v"))
        .otherwise(F.col("sink_value")).alias("sink_value"))
