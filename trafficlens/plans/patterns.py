"""Catalog queries: joins, documented investigation patterns (2.L), date
functions (K21-K24), SQL pass-through (A11) and NDJSON rows (A9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.operators.details import child_counts, request_details, span_tree
from trafficlens.operators.logs import request_logs
from trafficlens.operators.metrics import metrics
from trafficlens.plans.catalog import SINCE, UNTIL, W, query
from trafficlens.sources.sinks import ndjson_text
from trafficlens.sources.sql import run_sql

JAN = "timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31'"


@query("q_consumer_activity", W("request_logs", "consumers") + """
SELECT r.timestamp, r.request_uuid, r.method, r.url, r.status_code, r.response_time_ms, c.identifier
FROM request_logs r
JOIN consumers c ON r.app_id = c.app_id AND r.consumer_id = c.consumer_id
WHERE r.timestamp >= TIMESTAMP '2024-01-01' AND r.timestamp < TIMESTAMP '2024-01-31'
  AND c.identifier LIKE '%@example.com'""")
def q_consumer_activity(v):
    """Consumers' activity: request logs joined to consumers on (app_id, consumer_id),
    time-ordered (G1, L3)."""
    logs = request_logs(v["request_logs"], since=SINCE, until=UNTIL, ordered=False,
                        fields=["consumer_id", "status_code", "response_time_ms"],
                        keep_app_id=True)
    cons = v["consumers"].filter(F.col("identifier").like("%@example.com")) \
        .select("app_id", "consumer_id", "identifier")
    j = logs.join(cons, ["app_id", "consumer_id"])
    return (j.orderBy("timestamp", "request_uuid")
            .select("timestamp", "request_uuid", "method", "url", "status_code",
                    "response_time_ms", "identifier"))


@query("q_metrics_consumer_names", W("request_logs", "consumers") + """
, m AS (SELECT app_id, date_trunc('day', timestamp) AS period_start,
               CAST(consumer_id AS BIGINT) AS consumer_id, count(*) AS requests
        FROM request_logs GROUP BY 1, 2, 3)
SELECT m.app_id, m.period_start, m.consumer_id, c.identifier, c.name, CAST(m.requests AS BIGINT) AS requests
FROM m JOIN consumers c ON m.app_id = c.app_id AND m.consumer_id = CAST(c.consumer_id AS BIGINT)""")
def q_metrics_consumer_names(v):
    """Metrics by consumer joined to consumer names; BIGINT vs INT key cast."""
    m = metrics(v["request_logs"], ["requests"], interval="day", group_by=["consumer_id"])
    c = v["consumers"].select("app_id", F.col("consumer_id").cast("bigint").alias("consumer_id"),
                              "identifier", "name")
    return m.join(c, ["app_id", "consumer_id"]).select(
        "app_id", "period_start", "consumer_id", "identifier", "name", "requests")


@query("q_join_apps", W("request_logs", "apps", "endpoints") + """
SELECT a.app_id, a.name AS app_name, a.framework,
       CAST(count(*) AS BIGINT) AS requests,
       CAST((SELECT count(*) FROM endpoints e WHERE e.app_id = a.app_id) AS BIGINT) AS n_endpoints
FROM request_logs r JOIN apps a ON r.app_id = a.app_id
GROUP BY a.app_id, a.name, a.framework""")
def q_join_apps(v):
    """request_logs and endpoints joined to apps on app_id (G3). Requests are
    aggregated per app first, then joined to the apps table."""
    per_app = v["request_logs"].groupBy("app_id").agg(F.count(F.lit(1)).alias("requests"))
    eps = v["endpoints"].groupBy("app_id").agg(F.count(F.lit(1)).alias("n_endpoints"))
    apps = v["apps"].select("app_id", F.col("name").alias("app_name"), "framework")
    j = per_app.join(apps, "app_id").join(eps, "app_id", "left")
    return j.select("app_id", "app_name", "framework", "requests",
                    F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"))


@query("q_join_envs", W("request_logs", "app_envs") + """
SELECT e.app_id, e.app_env_id, e.name AS env, CAST(count(*) AS BIGINT) AS requests,
       CAST(count(*) FILTER (WHERE r.status_code >= 400) AS BIGINT) AS errors
FROM request_logs r JOIN app_envs e ON r.app_id = e.app_id AND r.env = e.name
GROUP BY 1, 2, 3""")
def q_join_envs(v):
    """request_logs.env matched to app_envs.name by string plus app_id."""
    per_env = v["request_logs"].groupBy("app_id", "env").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") >= 400).alias("errors"))
    envs = v["app_envs"].select("app_id", "app_env_id", F.col("name").alias("env"))
    return per_env.join(envs, ["app_id", "env"]).select(
        "app_id", "app_env_id", "env", "requests", "errors")


@query("q_join_app_logs", W("request_logs", "application_logs") + """
SELECT l.app_id, l.request_uuid, l.seq, l.level, r.method, r.path, r.status_code
FROM application_logs l JOIN request_logs r ON l.app_id = r.app_id AND l.request_uuid = r.request_uuid""")
def q_join_app_logs(v):
    """application_logs joined to request_logs on (app_id, request_uuid)."""
    r = v["request_logs"].select("app_id", "request_uuid", "method", "path", "status_code")
    l = v["application_logs"].select("app_id", "request_uuid", "seq", "level")
    return l.join(r, ["app_id", "request_uuid"]).select(
        "app_id", "request_uuid", "seq", "level", "method", "path", "status_code")


@query("q_join_spans", W("request_logs", "spans") + """
SELECT s.app_id, s.request_uuid, s.span_id, s.name, s.kind, s.duration_ns, s.status,
       r.status_code, r.response_time_ms
FROM spans s JOIN request_logs r ON s.app_id = r.app_id AND s.request_uuid = r.request_uuid""")
def q_join_spans(v):
    """spans joined to request_logs on (app_id, request_uuid)."""
    r = v["request_logs"].select("app_id", "request_uuid", "status_code", "response_time_ms")
    s = v["spans"].select("app_id", "request_uuid", "span_id", "name", "kind", "duration_ns",
                          "status")
    return s.join(r, ["app_id", "request_uuid"])


_TREE_SQL = W("spans").replace("WITH ", "WITH RECURSIVE ", 1) + """
, tree AS (
  SELECT app_id, request_uuid, span_id, parent_span_id, name, 0 AS depth, name AS path
  FROM spans WHERE parent_span_id IS NULL
  UNION ALL
  SELECT s.app_id, s.request_uuid, s.span_id, s.parent_span_id, s.name, t.depth + 1,
         concat(t.path, ' > ', s.name)
  FROM spans s JOIN tree t
    ON s.app_id = t.app_id AND s.request_uuid = t.request_uuid AND s.parent_span_id = t.span_id
),
kids AS (SELECT app_id, request_uuid, parent_span_id AS span_id, count(*) AS n_children
         FROM spans WHERE parent_span_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT t.app_id, t.request_uuid, t.span_id, t.parent_span_id, t.name, t.depth, t.path,
       coalesce(k.n_children, 0) AS n_children
FROM tree t LEFT JOIN kids k
  ON t.app_id = k.app_id AND t.request_uuid = k.request_uuid AND t.span_id = k.span_id"""


@query("q_span_tree", _TREE_SQL)
def q_span_tree(v):
    """Span tree through parent_span_id: depth, path, children."""
    return span_tree(v["spans"]).drop("place", "subtree", "cycle")


@query("q_span_tree_places", _TREE_SQL.rpartition("SELECT t.app_id")[0] + """
, up AS (
  SELECT app_id, request_uuid, span_id, span_id AS node FROM spans
  UNION ALL
  SELECT u.app_id, u.request_uuid, u.span_id, p.parent_span_id
  FROM up u JOIN spans p ON p.app_id = u.app_id AND p.request_uuid = u.request_uuid AND p.span_id = u.node
  WHERE p.parent_span_id IS NOT NULL),
size AS (SELECT app_id, request_uuid, node AS span_id, count(*) AS subtree FROM up GROUP BY 1, 2, 3)
SELECT s.app_id, s.request_uuid, s.span_id, z.subtree,
       CAST(row_number() OVER (PARTITION BY s.app_id, s.request_uuid, s.parent_span_id ORDER BY s.start_time_ns, s.span_id) AS INTEGER) AS place
FROM spans s JOIN size z ON s.app_id = z.app_id AND s.request_uuid = z.request_uuid AND s.span_id = z.span_id""")
def q_span_tree_places(v):
    """Each span's place among its siblings and the size of its subtree."""
    return span_tree(v["spans"]).select("app_id", "request_uuid", "span_id", "subtree", "place")


# In every request whose number ends in 3, the root hangs below its own child span 2.
_LOOPED = "CASE WHEN parent_span_id IS NULL AND request_uuid LIKE '%3' THEN concat(substr(span_id, 1, length(span_id) - 1), '2') ELSE parent_span_id END"


@query("q_span_tree_cycles", W("spans").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, s AS (SELECT app_id, request_uuid, span_id, name, {_LOOPED} AS above FROM spans),
walk AS (
  SELECT app_id, request_uuid, span_id, above AS node FROM s WHERE above IS NOT NULL
  UNION
  SELECT w.app_id, w.request_uuid, w.span_id, p.above
  FROM walk w JOIN s p ON p.app_id = w.app_id AND p.request_uuid = w.request_uuid AND p.span_id = w.node
  WHERE p.above IS NOT NULL),
looped AS (SELECT DISTINCT app_id, request_uuid, span_id FROM walk WHERE node = span_id),
cut AS (SELECT s.*, l.span_id IS NOT NULL AS cycle FROM s LEFT JOIN looped l USING (app_id, request_uuid, span_id)),
tree AS (
  SELECT app_id, request_uuid, span_id, 0 AS depth, name AS path, cycle FROM cut WHERE above IS NULL OR cycle
  UNION ALL
  SELECT c.app_id, c.request_uuid, c.span_id, t.depth + 1, concat(t.path, ' > ', c.name), c.cycle
  FROM cut c JOIN tree t ON c.app_id = t.app_id AND c.request_uuid = t.request_uuid AND c.above = t.span_id WHERE NOT c.cycle)
SELECT app_id, request_uuid, span_id, CAST(depth AS INTEGER) AS depth, path, cycle FROM tree""")
def q_span_tree_cycles(v):
    """Span trees where some roots hang below their own descendants: nothing is lost, cycles are marked."""
    looped = v["spans"].withColumn("parent_span_id", F.expr(_LOOPED))
    return span_tree(looped).select("app_id", "request_uuid", "span_id", F.col("depth").cast("int").alias("depth"), "path", "cycle")


@query("q_span_tree_orphans", W("spans").replace("WITH ", "WITH RECURSIVE ", 1) + """
, kept AS (SELECT * FROM spans WHERE name <> 'handler'),
tree AS (
  SELECT app_id, request_uuid, span_id, parent_span_id, name, 0 AS depth, name AS path
  FROM kept k WHERE parent_span_id IS NULL OR NOT EXISTS (
    SELECT 1 FROM kept p WHERE p.app_id = k.app_id AND p.request_uuid = k.request_uuid AND p.span_id = k.parent_span_id)
  UNION ALL
  SELECT s.app_id, s.request_uuid, s.span_id, s.parent_span_id, s.name, t.depth + 1, t.path || ' > ' || s.name
  FROM kept s JOIN tree t ON s.app_id = t.app_id AND s.request_uuid = t.request_uuid AND s.parent_span_id = t.span_id)
SELECT app_id, request_uuid, span_id, name, CAST(depth AS INTEGER) AS depth, path FROM tree""")
def q_span_tree_orphans(v):
    """Span tree where the spans named handler were never captured: their children are roots."""
    return span_tree(v["spans"].filter("name <> 'handler'")).select(
        "app_id", "request_uuid", "span_id", "name", F.col("depth").cast("int").alias("depth"), "path")


@query("q_request_details_counts", W("request_logs", "application_logs", "spans") + """
SELECT r.app_id, r.request_uuid,
       CAST(coalesce(l.n, 0) AS BIGINT) AS n_logs, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans
FROM request_logs r
LEFT JOIN (SELECT app_id, request_uuid, count(*) AS n FROM application_logs GROUP BY 1, 2) l
  ON r.app_id = l.app_id AND r.request_uuid = l.request_uuid
LEFT JOIN (SELECT app_id, request_uuid, count(*) AS n FROM spans GROUP BY 1, 2) s
  ON r.app_id = s.app_id AND r.request_uuid = s.request_uuid""")
def q_request_details_counts(v):
    """Children per request of the request-details document (G9, counts)."""
    return child_counts(v["request_logs"], v["application_logs"], v["spans"])


@query("q_request_details")
def q_request_details(v):
    """The nested request-details document of one request (G9); rows-only check."""
    return request_details(v["request_logs"], v["application_logs"], v["spans"],
                           request_uuid="req-000000000040", app_id=[1, 2, 3])


@query("q_error_drilldown", W("request_logs") + f"""
SELECT timestamp, request_uuid, method, url, status_code, response_body_json, exception_type, exception_message
FROM request_logs
WHERE {JAN} AND method = 'GET' AND path = '/v1/accounts/{{account_id}}' AND status_code = 500
ORDER BY timestamp, request_uuid LIMIT 5""")
def q_error_drilldown(v):
    """Drill-down into one failing endpoint, limit 5 (L2)."""
    return request_logs(
        v["request_logs"], since=SINCE, until=UNTIL, limit=5,
        fields=["timestamp", "request_uuid", "url", "status_code", "response_body_json",
                "exception_type", "exception_message"],
        filters=[{"field": "method", "op": "eq", "value": "GET"},
                 {"field": "path", "op": "eq", "value": "/v1/accounts/{account_id}"},
                 {"field": "status_code", "op": "eq", "value": 500}])


@query("q_daily_counts", W("request_logs") + f"""
SELECT date_trunc('day', timestamp) AS day, CAST(count(*) AS BIGINT) AS n
FROM request_logs WHERE {JAN} GROUP BY day""")
def q_daily_counts(v):
    """Requests per day with date_trunc."""
    d = v["request_logs"].filter((F.col("timestamp") >= F.lit(SINCE).cast("timestamp")) &
                                 (F.col("timestamp") < F.lit(UNTIL).cast("timestamp")))
    return d.groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


@query("q_daily_counts_tz", W("request_logs") + f"""
SELECT date_trunc('day', (timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS day,
       CAST(count(*) AS BIGINT) AS n
FROM request_logs WHERE {JAN} GROUP BY day""")
def q_daily_counts_tz(v):
    """Requests per local day: ts AT TIME ZONE."""
    d = v["request_logs"].filter((F.col("timestamp") >= F.lit(SINCE).cast("timestamp")) &
                                 (F.col("timestamp") < F.lit(UNTIL).cast("timestamp")))
    local = F.from_utc_timestamp("timestamp", "America/New_York")
    return d.groupBy(F.date_trunc("day", local).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("q_date_cast", W("request_logs") + f"""
SELECT CAST(timestamp AS DATE) AS day, status_code, CAST(count(*) AS BIGINT) AS n
FROM request_logs WHERE {JAN} GROUP BY 1, 2""")
def q_date_cast(v):
    """Timestamp cast to DATE."""
    d = v["request_logs"].filter((F.col("timestamp") >= F.lit(SINCE).cast("timestamp")) &
                                 (F.col("timestamp") < F.lit(UNTIL).cast("timestamp")))
    return d.groupBy(F.to_date("timestamp").alias("day"), "status_code").agg(
        F.count(F.lit(1)).alias("n"))


@query("q_consumer_search", W("consumers") + """
SELECT app_id, consumer_id, identifier, name, "group" FROM consumers
WHERE identifier ILIKE '%@EXAMPLE.COM'""")
def q_consumer_search(v):
    """Consumer lookup by identifier pattern, ILIKE."""
    return (v["consumers"].filter(F.col("identifier").ilike("%@EXAMPLE.COM"))
            .select("app_id", "consumer_id", "identifier", "name", "group"))


_PASSTHROUGH = ("SELECT method, path, status_code, COUNT(*) AS n FROM request_logs "
                "WHERE timestamp >= '2024-01-01' AND status_code >= 400 GROUP BY ALL")


@query("q_sql_passthrough", W("request_logs") + _PASSTHROUGH)
def q_sql_passthrough(v):
    """Free SQL over the registered tables."""
    return run_sql(v["request_logs"].sparkSession, _PASSTHROUGH)


@query("q_ndjson_rows", W("request_logs") + """
SELECT CAST(to_json({'request_uuid': request_uuid, 'method': method, 'consumer_id': consumer_id,
                'status_code': status_code, 'exception_type': exception_type}) AS VARCHAR) AS line
FROM request_logs""")
def q_ndjson_rows(v):
    """NDJSON lines with explicit nulls."""
    return ndjson_text(v["request_logs"].select("request_uuid", "method", "consumer_id",
                                                "status_code", "exception_type"))


_ERRORS_BY_ENDPOINT = ("SELECT status_code, method, path, app_id, count(*) AS failures FROM request_logs "
                       "WHERE status_code BETWEEN 400 AND 599 AND timestamp >= '2024-01-01' "
                       "AND timestamp < '2024-01-31' GROUP BY ALL ORDER BY failures DESC, path, status_code, app_id")


@query("q_errors_by_endpoint", W("request_logs") + _ERRORS_BY_ENDPOINT)
def q_errors_by_endpoint(v):
    """COUNT(*) with GROUP BY ALL, busiest first, as free SQL."""
    return run_sql(v["request_logs"].sparkSession, _ERRORS_BY_ENDPOINT)


_TS_FMT = "%Y-%m-%dT%H:%M:%S.%fZ"


@query("q_request_details_doc", W("request_logs", "application_logs", "spans") + f"""
SELECT r.app_id, r.request_uuid, CAST(to_json({{
  'timestamp': strftime(r.timestamp, '{_TS_FMT}'), 'request_uuid': r.request_uuid,
  'env': r.env, 'method': r.method, 'path': r.path, 'url': r.url, 'consumer_id': r.consumer_id,
  'request_headers': [[h.name, h.value] FOR h IN r.request_headers],
  'request_size_bytes': r.request_size_bytes, 'request_body_json': r.request_body_json,
  'status_code': r.status_code, 'response_time_ms': r.response_time_ms,
  'response_headers': [[h.name, h.value] FOR h IN r.response_headers],
  'response_size_bytes': r.response_size_bytes, 'response_body_json': r.response_body_json,
  'client_ip': r.client_ip, 'client_country_iso_code': r.client_country_iso_code,
  'trace_id': r.trace_id,
  'exception': CASE WHEN r.exception_type IS NOT NULL OR r.exception_message IS NOT NULL THEN
     {{'type': r.exception_type, 'message': r.exception_message,
       'stacktrace': r.exception_stacktrace, 'sentry_event_id': r.sentry_event_id}} END,
  'logs': coalesce((SELECT list({{'timestamp': strftime(l.timestamp, '{_TS_FMT}'),
       'message': l.message, 'level': l.level, 'logger': l.logger, 'file': l.file,
       'line': l.line}} ORDER BY l.timestamp, l.seq)
     FROM application_logs l WHERE l.app_id = r.app_id AND l.request_uuid = r.request_uuid), []),
  'spans': coalesce((SELECT list({{'span_id': s.span_id, 'parent_span_id': s.parent_span_id,
       'name': s.name, 'kind': s.kind, 'start_time_ns': s.start_time_ns,
       'end_time_ns': s.end_time_ns, 'duration_ns': s.duration_ns, 'status': s.status,
       'attributes': json(s.attributes)}} ORDER BY s.start_time_ns, s.span_id)
     FROM spans s WHERE s.app_id = r.app_id AND s.request_uuid = r.request_uuid), [])
}}) AS VARCHAR) AS json
FROM request_logs r WHERE r.request_uuid = 'req-000000000040'""")
def q_request_details_doc(v):
    """The request-details document of one request as JSON text in the wire shape."""
    from trafficlens.operators.details import request_details_json
    return request_details_json(request_details(
        v["request_logs"], v["application_logs"], v["spans"], request_uuid="req-000000000040",
        app_id=[1, 2, 3]))
