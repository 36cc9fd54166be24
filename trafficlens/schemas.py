"""Canonical table schemas, request-log field lists and the filter operator matrix."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()

HEADER = T.ArrayType(T.StructType([T.StructField("name", S), T.StructField("value", S)]))


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


APPS = _st(("app_id", I, False), ("name", S, False), ("framework", S, False),
           ("client_id", S, False), ("created_at", TS, False))

APP_ENVS = _st(("app_id", I, False), ("app_env_id", I, False), ("name", S, False),
               ("created_at", TS, False), ("last_sync_at", TS, True))

# "group" is a reserved word: quote it with backticks in Spark SQL.
CONSUMERS = _st(("app_id", I, False), ("consumer_id", I, False), ("identifier", S, False),
                ("name", S, False), ("group", S, True), ("created_at", TS, False),
                ("last_request_at", TS, True))

ENDPOINTS = _st(("app_id", I, False), ("endpoint_id", I, False), ("method", S, False),
                ("path", S, False))

METRICS = _st(("app_id", I, False), ("period_start", TS, False), ("period_end", TS, False),
              ("env", S, True), ("consumer_id", L, True), ("method", S, True), ("path", S, True),
              ("status_code", I, True), ("requests", L, True), ("requests_per_minute", D, True),
              ("bytes_received", L, True), ("bytes_sent", L, True), ("client_errors", L, True),
              ("server_errors", L, True), ("error_rate", D, True),
              ("response_time_p50", I, True), ("response_time_p75", I, True),
              ("response_time_p90", I, True), ("response_time_p95", I, True),
              ("response_time_p99", I, True))

REQUEST_LOGS = _st(("app_id", I, False), ("timestamp", TS, False), ("request_uuid", S, False),
                   ("env", S, True), ("method", S, False), ("path", S, True), ("url", S, False),
                   ("consumer_id", I, True), ("request_headers", HEADER, True),
                   ("request_size_bytes", L, True), ("request_body_json", S, True),
                   ("status_code", I, True), ("response_time_ms", I, True),
                   ("response_headers", HEADER, True), ("response_size_bytes", L, True),
                   ("response_body_json", S, True), ("client_ip", S, True),
                   ("client_country_iso_code", S, True), ("exception_type", S, True),
                   ("exception_message", S, True), ("exception_stacktrace", S, True),
                   ("sentry_event_id", S, True), ("trace_id", S, True))

APPLICATION_LOGS = _st(("app_id", I, False), ("request_uuid", S, False), ("timestamp", TS, False),
                       ("message", S, False), ("level", S, True), ("logger", S, True),
                       ("file", S, True), ("line", I, True))

SPANS = _st(("app_id", I, False), ("request_uuid", S, False), ("span_id", S, False),
            ("parent_span_id", S, True), ("name", S, False), ("kind", S, False),
            ("start_time_ns", L, False), ("end_time_ns", L, False), ("duration_ns", L, False),
            ("status", S, False), ("attributes", S, True))

TABLES = {
    "apps": APPS, "app_envs": APP_ENVS, "consumers": CONSUMERS, "endpoints": ENDPOINTS,
    "metrics": METRICS, "request_logs": REQUEST_LOGS, "application_logs": APPLICATION_LOGS,
    "spans": SPANS,
}

# Unique keys used by upsert; tables without one are written by range or children replace.
TABLE_KEYS = {
    "apps": ["app_id"], "app_envs": ["app_id", "app_env_id"],
    "consumers": ["app_id", "consumer_id"], "endpoints": ["app_id", "endpoint_id"],
    "request_logs": ["app_id", "request_uuid"],
}

# The request-log field list in canonical order, with its type class and
# whether it is part of the default field set.
REQUEST_LOG_FIELDS = [
    ("timestamp", "datetime", True),
    ("request_uuid", "string_id", True),
    ("env", "string", True),
    ("method", "string", True),
    ("path", "string", True),
    ("url", "string", True),
    ("consumer_id", "int_id", True),
    ("request_headers", "headers", False),
    ("request_size_bytes", "int", True),
    ("request_body_json", "json", False),
    ("status_code", "int", True),
    ("response_time_ms", "int", True),
    ("response_headers", "headers", False),
    ("response_size_bytes", "int", True),
    ("response_body_json", "json", False),
    ("client_ip", "string", True),
    ("client_country_iso_code", "string", True),
    ("exception_type", "string", False),
    ("exception_message", "string", False),
    ("exception_stacktrace", "string", False),
    ("sentry_event_id", "string_id", False),
    ("trace_id", "string_id", False),
]
LOG_FIELD_NAMES = [f for f, _, _ in REQUEST_LOG_FIELDS]
LOG_FIELD_TYPES = {f: t for f, t, _ in REQUEST_LOG_FIELDS}
DEFAULT_LOG_FIELDS = [f for f, _, d in REQUEST_LOG_FIELDS if d]
ALWAYS_LOG_FIELDS = ["timestamp", "request_uuid", "method", "url"]

# Operators allowed per field type class.
_STRING_OPS = {"eq", "neq", "in", "not_in", "like", "not_like", "ilike", "not_ilike",
               "contains", "not_contains", "is_null", "is_not_null"}
LOG_OPS = {
    "string": _STRING_OPS,
    "json": _STRING_OPS,
    "datetime": {"eq", "neq", "gt", "gte", "lt", "lte"},
    "string_id": {"eq", "neq", "in", "not_in", "is_null", "is_not_null"},
    "int_id": {"eq", "neq", "in", "not_in", "is_null", "is_not_null"},
    "headers": {"eq", "neq", "in", "not_in", "like", "not_like", "ilike", "not_ilike",
                "contains", "not_contains", "exists", "not_exists"},
    "int": {"eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in"},
}

# Metrics filter fields and their operators.
METRIC_FILTER_TYPES = {"env": "mstring", "method": "mstring", "path": "mstring",
                       "consumer_id": "mint", "status_code": "mint"}
METRIC_OPS = {
    "mstring": {"eq", "neq", "in", "not_in", "like", "not_like", "contains", "not_contains"},
    "mint": {"eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in", "is_null", "is_not_null"},
}

# Metric names, group-by fields and intervals of the metrics operator.
METRIC_NAMES = ["requests", "requests_per_minute", "bytes_received", "bytes_sent",
                "client_errors", "server_errors", "error_rate", "response_time_p50",
                "response_time_p75", "response_time_p90", "response_time_p95",
                "response_time_p99"]
GROUP_FIELDS = ["env", "consumer_id", "method", "path", "status_code"]
INTERVALS = ["month", "day", "hour", "minute"]

MAX_SAMPLE_RATE = 0.5
