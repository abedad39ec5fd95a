"""Schemas and the fixed values that decide results."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: severities, their ordinals, accepted column names ---------
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
SEVERITY_ORDINAL = {"INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}

ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "date"),
    "status_code": ("status_code", "status", "code", "response_code"),
    "event_type": ("event_type", "request_type", "event", "method", "action", "type"),
    "derived_source": ("service", "server", "host"),
    "derived_severity": ("level", "log_level"),
    "ip_address": ("ip_address", "ip", "client_ip", "host_ip"),
    "endpoint": ("endpoint", "url", "path", "route", "uri"),
    "message": ("message", "msg", "details", "description"),
}

# --- Fixed values: signal weights and limits ---------------------------------
WEIGHTS = {
    "geo_high_risk": 60,
    "geo_spoofing_ip": 55,
    "bot_malicious_action": 50,
    "severity_critical": 35,
    "high_frequency": 25,
    "status_repeated_404": 20,
    "isolation_forest": 15,
    "status_auth_fail": 15,
    "rare_event": 10,
    "severity_error": 10,
    "status_500_plus": 10,
}
THRESHOLD = 50
CONTAMINATION = 0.05
HIGH_RISK_LOCATIONS = ("north korea", "kp", "syria", "iran", "cuba")
SOURCE_LOCATIONS = ("north korea", "germany", "brazil", "india", "usa", "france", "canada", "china")
RARE_LOCATION_SHARE = 0.005
RARE_EVENT_SHARE = 0.01
WINDOW_SECONDS = 300
MIN_BURST = 5.0

# --- Fixed values: record defaults -------------------------------------------
DETECTED_BY = "Hybrid Rule-Based + Isolation Forest"
DEFAULT_MODEL = "gemini-3.5-flash-lite"

LOG_VALID = T.StructType([
    T.StructField("row_no", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("source", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("is_duplicate", T.BooleanType()),
])

LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("source", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("message", T.StringType()),
])

# Columns a scored log has beyond LOG; absent ones are read as null.
STORED_EXTRAS = {
    "uuid": "string",
    "anomaly": "boolean",
    "anomaly_score": "double",
    "anomaly_reason": "string",
    "ai_explanation": "string",
    "ai_root_cause": "string",
    "ai_next_step": "string",
    "ai_model": "string",
    "ai_analyzed_at": "timestamp_ntz",
    "created_at": "timestamp_ntz",
    "updated_at": "timestamp_ntz",
}
