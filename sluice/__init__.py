"""sluice: event-log triage as Spark DataFrame operators.

Validates JSON envelopes, routes events to handlers by (type, version), keeps
per-entity order, removes repeats inside a fixed claim window, classifies every
message into exactly one outcome (processed, duplicate, retry, dead letter,
scheduled) and schedules retries -- on batch tables and Structured Streaming.
"""
from sluice.session import get_spark, checkpoint_dir  # noqa: F401
