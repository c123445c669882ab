"""Explicit schemas of the tables (no inference at read time)."""

from __future__ import annotations

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
ERROR_LEVELS = ("ERROR", "CRITICAL")
ALERT_SEVERITIES = ("low", "medium", "high", "critical")
ALERT_STATUSES = ("pending", "sent", "failed", "suppressed")
CHANNELS = ("slack", "pagerduty", "email", "webhook")

LOGS = (
    "id STRING, timestamp TIMESTAMP, service_name STRING, level STRING, message STRING, trace_id STRING, "
    "span_id STRING, host STRING, environment STRING, attributes MAP<STRING,STRING>"
)

# A log record on the wire: the timestamp stays text until it is parsed and checked.
LOG_WIRE = LOGS.replace("timestamp TIMESTAMP", "timestamp STRING")

FEATURES = (
    "window_id STRING, service_name STRING, window_start TIMESTAMP, window_end TIMESTAMP, window_seconds INT, "
    "total_logs BIGINT, logs_per_second DOUBLE, error_count BIGINT, critical_count BIGINT, error_rate DOUBLE, "
    "latency_p50 DOUBLE, latency_p95 DOUBLE, latency_p99 DOUBLE, latency_mean DOUBLE, unique_traces BIGINT"
)

DETECTOR_RESULT = (
    "STRUCT<detector_name: STRING, score: DOUBLE, triggered_on: ARRAY<STRING>, details: MAP<STRING,STRING>>"
)

ROOT_CAUSE = (
    "root_cause STRING, confidence DOUBLE, severity STRING, affected_services ARRAY<STRING>, "
    "affected_users_estimate STRING, timeline ARRAY<STRING>, contributing_factors ARRAY<STRING>, "
    "recommended_action STRING, remediation_steps ARRAY<STRING>, escalate_to STRING"
)

ANALYSES = (
    "id STRING, analyzed_at TIMESTAMP, service_name STRING, anomaly_id STRING, anomaly_score DOUBLE, severity STRING, "
    "root_cause STRING, confidence DOUBLE, affected_services ARRAY<STRING>, recommended_action STRING, "
    "remediation_steps ARRAY<STRING>, timeline ARRAY<STRING>, contributing_factors ARRAY<STRING>, escalate_to STRING, "
    "llm_model STRING, prompt_tokens INT, completion_tokens INT, analysis_duration_ms DOUBLE, success BOOLEAN, "
    "error_message STRING, raw_result STRING"
)

ALERTS = (
    "id STRING, created_at TIMESTAMP, sent_at TIMESTAMP, analysis_id STRING, anomaly_id STRING, service_name STRING, "
    "severity STRING, status STRING, title STRING, root_cause STRING, confidence DOUBLE, recommended_action STRING, "
    "affected_services ARRAY<STRING>, remediation_steps ARRAY<STRING>, escalate_to STRING, "
    "channels_attempted ARRAY<STRING>, channels_succeeded ARRAY<STRING>, error_messages ARRAY<STRING>"
)

EDGES = "caller STRING, callee STRING"
RULES = "severity STRING, channels ARRAY<STRING>, require_confidence_above DOUBLE, cooldown_seconds INT"
METRIC_SAMPLES = "metric STRING, labels MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"
