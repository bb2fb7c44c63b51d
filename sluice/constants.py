"""Fixed values that must equal the reference worker's behaviour.

Every value below is a constant of the event worker being re-expressed; they
are kept together, in their natural order, so they can be audited in one place.
"""

# --- fixed values: topics and per-topic lane counts (worker defaults) ---------
MAIN_TOPICS = ("cases", "payments", "visits", "notifications")
LANES = {"cases": 50, "payments": 20, "visits": 20, "notifications": 50}
RETRY_SUFFIX = ".retry"
DLQ_SUFFIX = ".dlq"

# --- fixed values: handler registry (event type, version) -------------------
REGISTRY = (("VISIT_APPROVED", 1), ("NOTIFICATION_TRIGGERED", 1))

# --- fixed values: retry policy ---------------------------------------------
MAX_RETRIES = 5
BACKOFF_SECONDS = (30, 60, 300, 900, 1800)  # 30 s, 1 m, 5 m, 15 m, 30 m
REPUBLISH_FAILURE_DELAY_S = 15
DUE_BATCH_LIMIT = 500
RETRY_PAYLOAD_TTL_S = 24 * 3600

# --- fixed values: idempotency claim -----------------------------------------
DEDUP_TTL_S = 48 * 3600

# --- fixed values: latency histogram buckets (client-library defaults) -------
HISTOGRAM_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

# --- fixed values: reason texts ----------------------------------------------
INVALID_ENVELOPE = "invalid envelope: "
MISSING_VERSION = "missing or zero version"
MISSING_EVENT_ID = "missing eventId"
MISSING_EVENT_TYPE = "missing eventType"
MISSING_TENANT_ID = "missing tenantId"
MISSING_TIMESTAMP = "missing timestamp"
MISSING_DATA = "missing data"
INVALID_TIMESTAMP = "invalid timestamp: "
JSON_UNMARSHAL = "json unmarshal: "
UNKNOWN_TYPE = "no processor registered for event type: "
NO_POOL = "no worker pool for topic"
BUSINESS = "business validation: "
PANIC = "panic: "
INVALID_RETRY_ENVELOPE = "invalid retry envelope: "
RETRY_MISSING_IDS = "invalid retry envelope: missing eventId or originalTopic"
UNMARSHAL_RETRY = "unmarshal retry envelope: "

# --- fixed values: type names a typed JSON decoder prints in its error texts --
ENVELOPE_STRUCT, ENVELOPE_TYPE = "rawEnvelope", "event.rawEnvelope"
RETRY_STRUCT, RETRY_TYPE = "RetryEnvelope", "retry.RetryEnvelope"
VISIT_STRUCT, VISIT_TYPE = "VisitApprovedData", "processor.VisitApprovedData"
NOTIFICATION_STRUCT, NOTIFICATION_TYPE = "NotificationTriggeredData", "processor.NotificationTriggeredData"

# --- error classes (this library's labels for the worker's error kinds) ------
EC_INVALID = "invalid_envelope"
EC_UNKNOWN = "unknown_event_type"
EC_UNROUTED = "no_pool"
EC_BUSINESS = "business_validation"
EC_PANIC = "panic"
EC_ERROR = "processing_error"

# --- outcomes ----------------------------------------------------------------
PROCESSED = "processed"
DUPLICATE = "duplicate"
RETRY = "retry"
DLQ = "dlq"
SCHEDULED = "scheduled"
