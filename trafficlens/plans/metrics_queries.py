"""Catalog queries over the metrics operator."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from trafficlens.functions.timerange import retention
from trafficlens.operators.metrics import (ADDITIVE, QUANTILES, metrics, reaggregate, response_time_sketches,
                                           rollup)
from trafficlens.plans.catalog import NOW, SINCE, UNTIL, W, query

ALL = ["requests", "requests_per_minute", "bytes_received", "bytes_sent", "client_errors",
       "server_errors", "error_rate", "response_time_p50", "response_time_p75",
       "response_time_p90", "response_time_p95", "response_time_p99"]


def _pct_sql(col="response_time_ms"):
    return ",\n".join(
        f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {col}) AS INTEGER) AS response_time_p{n}"
        for p, n in ((0.5, 50), (0.75, 75), (0.9, 90), (0.95, 95), (0.99, 99)))


_ALL_SQL = """CAST(count(*) AS BIGINT) AS requests,
count(*) / ({minutes}) AS requests_per_minute,
CAST(sum(request_size_bytes) AS BIGINT) AS bytes_received,
CAST(sum(response_size_bytes) AS BIGINT) AS bytes_sent,
CAST(count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS BIGINT) AS client_errors,
CAST(count(*) FILTER (WHERE status_code >= 500) AS BIGINT) AS server_errors,
count(*) FILTER (WHERE status_code >= 400) / count(*) AS error_rate,
""" + _pct_sql()


def _utc_bucket_sql(unit: str, keys: str, where: str = "TRUE") -> str:
    step = {"month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR",
            "minute": "INTERVAL 1 MINUTE"}[unit]
    return W("request_logs") + f"""
SELECT app_id, period_start, period_start + {step} AS period_end{', ' + keys if keys else ''},
       {_ALL_SQL.format(minutes=f"(epoch(period_start + {step}) - epoch(period_start)) / 60.0")}
FROM (SELECT *, date_trunc('{unit}', timestamp) AS period_start FROM request_logs
      WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31' AND {where}) r
GROUP BY app_id, period_start{', ' + keys if keys else ''}"""


def _interval_query(unit):
    def fn(v):
        return metrics(v["request_logs"], ALL, since=SINCE, until=UNTIL, interval=unit,
                       group_by=["method", "path"])
    fn.__doc__ = f"All twelve metrics per {unit} by endpoint (F1-F14)."
    return fn


for _u in ("month", "day", "hour", "minute"):
    query(f"q_metrics_{_u}", _utc_bucket_sql(_u, "method, path"))(_interval_query(_u))


@query("q_metrics_total", W("request_logs") + f"""
SELECT app_id, TIMESTAMP '2024-01-01' AS period_start, TIMESTAMP '2024-01-31' AS period_end, env,
       {_ALL_SQL.format(minutes="43200.0")}
FROM request_logs WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31'
GROUP BY app_id, env""")
def q_metrics_total(v):
    """No interval: one row per group for the whole range."""
    return metrics(v["request_logs"], ALL, since=SINCE, until=UNTIL, group_by=["env"])


@query("q_metrics_requests", W("request_logs") + """
SELECT app_id, date_trunc('hour', timestamp) AS period_start,
       date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS period_end,
       CAST(count(*) AS BIGINT) AS requests
FROM request_logs GROUP BY 1, 2, 3""")
def q_metrics_requests(v):
    """Only the requested metric appears (F1, C4)."""
    return metrics(v["request_logs"], ["requests"], interval="hour")


@query("q_metrics_rpm", W("request_logs") + """
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, status_code,
       count(*) / 1440.0 AS requests_per_minute
FROM request_logs GROUP BY 1, 2, 3, 4""")
def q_metrics_rpm(v):
    """Requests per minute per day and status (F2)."""
    return metrics(v["request_logs"], ["requests_per_minute"], interval="day",
                   group_by=["status_code"])


@query("q_metrics_bytes", W("request_logs") + """
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, method,
       CAST(sum(request_size_bytes) AS BIGINT) AS bytes_received,
       CAST(sum(response_size_bytes) AS BIGINT) AS bytes_sent
FROM request_logs GROUP BY 1, 2, 3, 4""")
def q_metrics_bytes(v):
    """Bytes received and sent per day and method."""
    return metrics(v["request_logs"], ["bytes_received", "bytes_sent"], interval="day",
                   group_by=["method"])


@query("q_metrics_errors", W("request_logs") + """
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, path,
       CAST(count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS BIGINT) AS client_errors,
       CAST(count(*) FILTER (WHERE status_code >= 500) AS BIGINT) AS server_errors
FROM request_logs GROUP BY 1, 2, 3, 4""")
def q_metrics_errors(v):
    """Client and server errors per day and path."""
    return metrics(v["request_logs"], ["client_errors", "server_errors"], interval="day",
                   group_by=["path"])


@query("q_metrics_error_rate", W("request_logs") + """
SELECT app_id, date_trunc('hour', timestamp) AS period_start,
       date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS period_end, env,
       count(*) FILTER (WHERE status_code >= 400) / count(*) AS error_rate
FROM request_logs GROUP BY 1, 2, 3, 4""")
def q_metrics_error_rate(v):
    """Error rate per hour and environment (F8)."""
    return metrics(v["request_logs"], ["error_rate"], interval="hour", group_by=["env"])


@query("q_metrics_expected", W("request_logs") + """
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, path, status_code,
       CAST(count(*) FILTER (WHERE status_code BETWEEN 400 AND 499
            AND NOT (path = '/v1/accounts/{account_id}' AND status_code = 404)) AS BIGINT) AS client_errors,
       CAST(count(*) FILTER (WHERE status_code >= 500) AS BIGINT) AS server_errors,
       count(*) FILTER (WHERE status_code >= 400
            AND NOT (path = '/v1/accounts/{account_id}' AND status_code = 404)) / count(*) AS error_rate
FROM request_logs GROUP BY 1, 2, 3, 4, 5""")
def q_metrics_expected(v):
    """Expected 404s on the user endpoint are not errors (F7). The expected-error list
    is derived from the endpoints table (one row per app), so it scales with it."""
    exp = (v["endpoints"].filter((F.col("path") == "/v1/accounts/{account_id}"))
           .select("app_id", "method", "path", F.lit(404).alias("status_code")))
    return metrics(v["request_logs"], ["client_errors", "server_errors", "error_rate"],
                   interval="day", group_by=["path", "status_code"], expected_errors=exp)


@query("q_metrics_percentiles", W("request_logs") + f"""
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, method, path,
       {_pct_sql()}
FROM request_logs GROUP BY 1, 2, 3, 4, 5""")
def q_metrics_percentiles(v):
    """Exact discrete response-time percentiles per day and endpoint."""
    return metrics(v["request_logs"], [m for m in ALL if m.startswith("response_time")],
                   interval="day", group_by=["method", "path"])


# Time-zone buckets. Day: local midnight mapped back to UTC. Hour: UTC axis shifted by
# the zone's offset (Asia/Kolkata is +05:30, so hours start at :30 UTC).
_NY_LOCAL = "((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


@query("q_metrics_tz_day", W("request_logs") + f"""
SELECT app_id, period_start,
       ((period_local + INTERVAL 1 DAY) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS period_end,
       status_code, CAST(count(*) AS BIGINT) AS requests,
       count(*) / ((epoch(((period_local + INTERVAL 1 DAY) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')
                    - epoch(period_start)) / 60.0) AS requests_per_minute
FROM (SELECT *, date_trunc('day', {_NY_LOCAL}) AS period_local,
             (date_trunc('day', {_NY_LOCAL}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS period_start
      FROM request_logs) r
GROUP BY app_id, period_start, period_local, status_code""")
def q_metrics_tz_day(v):
    """Daily buckets in America/New_York (F16)."""
    return metrics(v["request_logs"], ["requests", "requests_per_minute"], interval="day",
                   group_by=["status_code"], timezone_name="America/New_York")


_KOL_OFF = "(epoch_us((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata') // 1000000 - epoch_us(timestamp) // 1000000)"


@query("q_metrics_tz_hour", W("request_logs") + f"""
SELECT app_id, period_start, period_start + INTERVAL 1 HOUR AS period_end, method,
       CAST(count(*) AS BIGINT) AS requests,
       count(*) / 60.0 AS requests_per_minute
FROM (SELECT *, make_timestamp((epoch_us(timestamp) // 1000000
              - (((epoch_us(timestamp) // 1000000 + {_KOL_OFF}) % 3600) + 3600) % 3600) * 1000000) AS period_start
      FROM request_logs) r
GROUP BY app_id, period_start, method""")
def q_metrics_tz_hour(v):
    """Hourly buckets in Asia/Kolkata (+05:30) (F16)."""
    return metrics(v["request_logs"], ["requests", "requests_per_minute"], interval="hour",
                   group_by=["method"], timezone_name="Asia/Kolkata")


@query("q_metrics_tz_range", W("request_logs") + """
SELECT app_id, TIMESTAMP '2024-01-10 05:00:00' AS period_start, TIMESTAMP '2024-01-20 05:00:00' AS period_end,
       CAST(count(*) AS BIGINT) AS requests
FROM request_logs
WHERE timestamp >= TIMESTAMP '2024-01-10 05:00:00' AND timestamp < TIMESTAMP '2024-01-20 05:00:00'
GROUP BY app_id""")
def q_metrics_tz_range(v):
    """Zone-less since/until are read in the metrics time zone."""
    return metrics(v["request_logs"], ["requests"], since="2024-01-10T00:00:00",
                   until="2024-01-20T00:00:00", timezone_name="America/New_York")


def _by(field):
    def fn(v):
        return metrics(v["request_logs"], ["requests", "error_rate", "response_time_p95"],
                       interval="day", group_by=[field])
    fn.__doc__ = f"Daily metrics grouped by {field} (F17)."
    return fn


for _name, _field in (("env", "env"), ("consumer", "consumer_id"), ("status", "status_code")):
    _cast = "CAST(consumer_id AS BIGINT) AS consumer_id" if _field == "consumer_id" else _field
    query(f"q_metrics_by_{_name}", W("request_logs") + f"""
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, {_cast},
       CAST(count(*) AS BIGINT) AS requests,
       count(*) FILTER (WHERE status_code >= 400) / count(*) AS error_rate,
       CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p95
FROM request_logs GROUP BY app_id, date_trunc('day', timestamp), {_field}""")(_by(_field))


@query("q_metrics_by_endpoint", W("request_logs") + """
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, method, path,
       CAST(count(*) AS BIGINT) AS requests,
       count(*) FILTER (WHERE status_code >= 400) / count(*) AS error_rate,
       CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p95
FROM request_logs GROUP BY 1, 2, 3, 4, 5""")
def q_metrics_by_endpoint(v):
    """Daily metrics grouped by endpoint (method, path)."""
    return metrics(v["request_logs"], ["requests", "error_rate", "response_time_p95"],
                   interval="day", group_by=["method", "path"])


@query("q_metrics_filtered", W("request_logs") + """
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, path, status_code,
       CAST(count(*) AS BIGINT) AS requests
FROM request_logs
WHERE method IN ('GET', 'PUT') AND path LIKE '/v1/accounts%' AND status_code >= 200
  AND consumer_id IS NOT NULL AND contains(lower(env), 'pro') AND path <> '/v1/orders'
GROUP BY 1, 2, 3, 4, 5""")
def q_metrics_filtered(v):
    """Metrics with the metrics filter variant."""
    flt = [{"field": "method", "op": "in", "value": ["GET", "PUT"]},
           {"field": "path", "op": "like", "value": "/v1/accounts%"},
           {"field": "status_code", "op": "gte", "value": 200},
           {"field": "consumer_id", "op": "is_not_null"},
           {"field": "env", "op": "contains", "value": "PRO"},
           {"field": "path", "op": "neq", "value": "/v1/orders"}]
    return metrics(v["request_logs"], ["requests"], interval="day",
                   group_by=["path", "status_code"], filters=flt)


def _metrics_filter(name: str, filters: list[dict], where: str) -> None:
    """Daily requests under one filter of the metrics variant, against its SQL."""

    @query(name, W("request_logs") + f"""
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, method,
       CAST(count(*) AS BIGINT) AS requests
FROM request_logs WHERE {where} GROUP BY 1, 2, 3, 4""")
    def build(v):
        return metrics(v["request_logs"], ["requests"], interval="day", group_by=["method"], filters=filters)

    build.__doc__ = f"Metrics filter: {where} (E23)."


for _i, (_field, _op, _value, _where) in enumerate([
        ("method", "eq", "GET", "method = 'GET'"), ("env", "neq", "dev", "env <> 'dev'"),
        ("path", "not_in", ["/v1/items", "/v1/orders"], "path NOT IN ('/v1/items', '/v1/orders')"),
        ("path", "not_like", "/v1/accounts%", "path NOT LIKE '/v1/accounts%'"),
        ("path", "not_contains", "ITEM", "NOT contains(lower(path), 'item')"),
        ("consumer_id", "eq", 8, "consumer_id = 8"), ("consumer_id", "neq", 7, "consumer_id <> 7"),
        ("status_code", "gt", 404, "status_code > 404"), ("status_code", "lt", 400, "status_code < 400"),
        ("status_code", "lte", 404, "status_code <= 404"), ("status_code", "in", [404, 500], "status_code IN (404, 500)"),
        ("status_code", "not_in", [200, 201], "status_code NOT IN (200, 201)"),
        ("consumer_id", "is_null", None, "consumer_id IS NULL")]):
    _metrics_filter(f"q_mf_{_field}_{_op}", [{"field": _field, "op": _op} | ({} if _value is None else {"value": _value})], _where)


@query("q_metrics_reaggregate_all", W("metrics") + """
SELECT app_id, method, CAST(sum(requests) AS BIGINT) AS requests_sum, CAST(sum(bytes_received) AS BIGINT) AS bytes_received_sum,
       CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent_sum, CAST(sum(client_errors) AS BIGINT) AS client_errors_sum,
       CAST(sum(server_errors) AS BIGINT) AS server_errors_sum
FROM metrics GROUP BY app_id, method""")
def q_metrics_reaggregate_all(v):
    """Every additive metric summed over stored hourly rows."""
    return reaggregate(v["metrics"], ["app_id", "method"], sums=ADDITIVE)


@query("q_metrics_apps", W("metrics", "apps") + """
SELECT a.app_id, a.name AS app_name, a.framework, CAST(coalesce(sum(m.requests), 0) AS BIGINT) AS requests
FROM apps a LEFT JOIN metrics m ON m.app_id = a.app_id GROUP BY 1, 2, 3""")
def q_metrics_apps(v):
    """Metrics summed per app beside the app's name; apps without traffic too."""
    per_app = v["metrics"].groupBy("app_id").agg(F.sum("requests").cast("bigint").alias("requests"))
    return v["apps"].join(per_app, "app_id", "left").select(
        "app_id", F.col("name").alias("app_name"), "framework", F.coalesce("requests", F.lit(0)).alias("requests"))


@query("q_metrics_envs", W("request_logs", "app_envs") + """
, m AS (SELECT app_id, env, count(*) AS requests FROM request_logs GROUP BY 1, 2)
SELECT e.app_id, e.app_env_id, m.env, e.last_sync_at, CAST(m.requests AS BIGINT) AS requests
FROM m JOIN app_envs e ON e.app_id = m.app_id AND e.name = m.env""")
def q_metrics_envs(v):
    """Metrics by env matched to app_envs by app and name."""
    m = metrics(v["request_logs"], ["requests"], since="2024-01-01T00:00:00Z", until="2024-02-01T00:00:00Z", group_by=["env"])
    e = v["app_envs"].withColumnRenamed("name", "env")
    return m.join(e, ["app_id", "env"]).select("app_id", "app_env_id", "env", "last_sync_at", "requests")


@query("q_metrics_reaggregate", W("metrics") + """
SELECT method, path, status_code, CAST(sum(requests) AS BIGINT) AS requests_sum
FROM metrics GROUP BY method, path, status_code""")
def q_metrics_reaggregate(v):
    """Sum stored hourly requests by endpoint and status."""
    return reaggregate(v["metrics"], ["method", "path", "status_code"])


@query("q_metrics_rollup_30m", W("request_logs") + """
SELECT app_id, period_start, period_start + INTERVAL 30 MINUTE AS period_end, method,
       CAST(count(*) AS BIGINT) AS requests, count(*) / 30.0 AS requests_per_minute,
       CAST(sum(request_size_bytes) AS BIGINT) AS bytes_received,
       CAST(sum(response_size_bytes) AS BIGINT) AS bytes_sent,
       CAST(count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS BIGINT) AS client_errors,
       CAST(count(*) FILTER (WHERE status_code >= 500) AS BIGINT) AS server_errors,
       count(*) FILTER (WHERE status_code >= 400) / count(*) AS error_rate
FROM (SELECT *, make_timestamp((epoch_us(timestamp) // 1000000
              - (epoch_us(timestamp) // 1000000) % 1800) * 1000000) AS period_start
      FROM request_logs) r
GROUP BY app_id, period_start, method""")
def q_metrics_rollup_30m(v):
    """1-minute metrics rolled up to 30-minute buckets."""
    minute = metrics(v["request_logs"], ["requests", "bytes_received", "bytes_sent",
                                         "client_errors", "server_errors"],
                     interval="minute", group_by=["method"])
    return rollup(minute, 1800, ["method"])


@query("q_metrics_rollup_percentiles", W("request_logs") + """
SELECT app_id, period_start, method, CAST(count(*) AS BIGINT) AS requests,
       CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p50,
       CAST(percentile_disc(0.75) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p75,
       CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p90,
       CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p95,
       CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p99
FROM (SELECT *, make_timestamp((epoch_us(timestamp) // 1000000
              - (epoch_us(timestamp) // 1000000) % 1800) * 1000000) AS period_start
      FROM request_logs) r
GROUP BY app_id, period_start, method""")
def q_metrics_rollup_percentiles(v):
    """Percentiles of the 30-minute tier from sketches stored per minute, without the logs."""
    logs = v["request_logs"]
    minute = metrics(logs, ["requests", "bytes_received", "bytes_sent", "client_errors", "server_errors"], interval="minute", group_by=["method"])
    sketches = response_time_sketches(logs, 60, ["method"])
    stored = minute.join(sketches, ["app_id", "period_start", "method"])
    return rollup(stored, 1800, ["method"]).select("app_id", "period_start", "method", "requests", *QUANTILES)


@query("q_retention", W("request_logs") + """
SELECT request_uuid, timestamp FROM request_logs WHERE timestamp >= TIMESTAMP '2024-01-16 00:00:00'""")
def q_retention(v):
    """Logs kept 15 days before now."""
    return retention(v["request_logs"].select("request_uuid", "timestamp"),
                     timedelta(days=15), NOW)


@query("q_metrics_overview", W("request_logs") + """
SELECT app_id, date_trunc('day', timestamp) AS period_start,
       date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, method, path,
       CAST(count(*) AS BIGINT) AS requests,
       count(*) FILTER (WHERE status_code >= 400) / count(*) AS error_rate,
       CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p50,
       CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY response_time_ms) AS INTEGER) AS response_time_p95
FROM request_logs
WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00' AND timestamp < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY 1, 2, 3, 4, 5""")
def q_metrics_overview(v):
    """Overview by endpoint and day for the last 7 days."""
    from datetime import datetime, timezone
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    return metrics(v["request_logs"], ["requests", "error_rate", "response_time_p50",
                                       "response_time_p95"],
                   since="7d", interval="day", group_by=["method", "path"], now=now)


@query("q_error_investigation", W("request_logs") + """
SELECT app_id, method, path, status_code, CAST(sum(requests) AS BIGINT) AS requests_sum
FROM (SELECT app_id, method, path, status_code, count(*) AS requests FROM request_logs
      WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31'
        AND status_code >= 400
      GROUP BY ALL) m
GROUP BY ALL""")
def q_error_investigation(v):
    """Errors by endpoint and status, busiest first (L1; the flagship query)."""
    return error_investigation(v["request_logs"])


def error_investigation(request_logs, since=SINCE, until=UNTIL):
    m = metrics(request_logs, ["requests"], since=since, until=until,
                group_by=["method", "path", "status_code"],
                filters=[{"field": "status_code", "op": "gte", "value": 400}])
    return (reaggregate(m, ["app_id", "method", "path", "status_code"])
            .orderBy(F.col("requests_sum").desc(), "app_id", "method", "path", "status_code"))



@query("q_metrics_tz_month", W("request_logs") + f"""
SELECT app_id, period_start,
       ((period_local + INTERVAL 1 MONTH) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS period_end,
       CAST(count(*) AS BIGINT) AS requests,
       count(*) / ((epoch(((period_local + INTERVAL 1 MONTH) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')
                    - epoch(period_start)) / 60.0) AS requests_per_minute
FROM (SELECT *, date_trunc('month', {_NY_LOCAL}) AS period_local,
             (date_trunc('month', {_NY_LOCAL}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS period_start
      FROM request_logs) r
GROUP BY app_id, period_start, period_local""")
def q_metrics_tz_month(v):
    """Monthly buckets in America/New_York: the first UTC hours of January fall into the
    local December bucket (F14, F16)."""
    return metrics(v["request_logs"], ["requests", "requests_per_minute"], interval="month",
                   timezone_name="America/New_York")
