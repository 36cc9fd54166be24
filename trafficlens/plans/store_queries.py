"""Catalog queries over the write semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions.timerange import ts_lit
from trafficlens.operators.metrics import metrics
from trafficlens.operators.store import (align, dedup, range_replace, range_replace_fetches,
                                         replace_children, upsert)
from trafficlens.plans.catalog import W, query

_RL_COLS = ["app_id", "request_uuid", "timestamp", "status_code", "response_time_ms",
            "request_body_json", "response_body_json"]
_RL_SQL = ", ".join(_RL_COLS)


def _between(df, col, lo=None, hi=None):
    if lo is not None:
        df = df.filter(F.col(col) >= ts_lit(lo))
    if hi is not None:
        df = df.filter(F.col(col) < ts_lit(hi))
    return df


@query("q_upsert_request_logs", W("request_logs") + f"""
, base AS (SELECT * FROM request_logs WHERE timestamp < TIMESTAMP '2024-01-20'),
staged AS (SELECT * REPLACE (response_time_ms + 1000 AS response_time_ms, 299 AS status_code)
           FROM request_logs WHERE timestamp >= TIMESTAMP '2024-01-15')
SELECT {_RL_SQL} FROM base
WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.app_id = base.app_id AND s.request_uuid = base.request_uuid)
UNION ALL SELECT {_RL_SQL} FROM staged""")
def q_upsert_request_logs(v):
    """INSERT OR REPLACE on (app_id, request_uuid): overlapping refetch (B1)."""
    rl = v["request_logs"]
    base = _between(rl, "timestamp", hi="2024-01-20")
    staged = (_between(rl, "timestamp", lo="2024-01-15")
              .withColumn("response_time_ms", F.col("response_time_ms") + 1000)
              .withColumn("status_code", F.lit(299)))
    return upsert(base, staged, table="request_logs").select(*_RL_COLS)


@query("q_upsert_null_overwrite", W("request_logs") + f"""
, base AS (SELECT * FROM request_logs),
staged AS (SELECT * REPLACE (NULL AS request_body_json, NULL AS response_body_json)
           FROM request_logs WHERE timestamp >= TIMESTAMP '2024-01-20')
SELECT {_RL_SQL} FROM base
WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.app_id = base.app_id AND s.request_uuid = base.request_uuid)
UNION ALL SELECT {_RL_SQL} FROM staged""")
def q_upsert_null_overwrite(v):
    """Whole-row replacement: fields not refetched become NULL (B2)."""
    rl = v["request_logs"]
    staged = _between(rl, "timestamp", lo="2024-01-20").select(
        "app_id", "timestamp", "request_uuid", "env", "method", "path", "url", "status_code",
        "response_time_ms", "consumer_id")
    return upsert(rl, staged, table="request_logs").select(*_RL_COLS)


_M_COLS = "app_id, period_start, period_end, method, path, status_code, CAST(requests AS BIGINT) AS requests"


def _staged_daily_sql(lo: str, hi: str) -> str:
    return f"""
staged AS (SELECT app_id, date_trunc('day', timestamp) AS period_start,
                  date_trunc('day', timestamp) + INTERVAL 1 DAY AS period_end, method,
                  CAST(NULL AS VARCHAR) AS path, CAST(NULL AS INTEGER) AS status_code,
                  count(*) AS requests
           FROM request_logs WHERE timestamp >= TIMESTAMP '{lo}' AND timestamp < TIMESTAMP '{hi}'
           GROUP BY 1, 2, 3, 4),
bounds AS (SELECT app_id, min(period_start) AS lo, max(period_end) AS hi FROM staged GROUP BY app_id)"""


@query("q_metrics_range_replace", W("request_logs", "metrics") + ", " + _staged_daily_sql(
    "2024-01-10 06:00:00", "2024-01-12 00:00:00") + f"""
SELECT {_M_COLS} FROM metrics m
WHERE NOT coalesce(m.period_start >= (SELECT lo FROM bounds b WHERE b.app_id = m.app_id)
              AND m.period_end <= (SELECT hi FROM bounds b WHERE b.app_id = m.app_id), false)
UNION ALL SELECT {_M_COLS} FROM staged""")
def q_metrics_range_replace(v):
    """A daily refetch by method replaces hourly rows contained in its range."""
    staged = metrics(v["request_logs"], ["requests"], since="2024-01-10T06:00:00Z",
                     until="2024-01-12T00:00:00Z", interval="day", group_by=["method"])
    out = range_replace(v["metrics"], align(staged, "metrics"))
    return out.select("app_id", "period_start", "period_end", "method", "path", "status_code",
                      "requests")


@query("q_metrics_range_replace_empty", W("request_logs", "metrics") + ", " + _staged_daily_sql(
    "2024-02-10 00:00:00", "2024-02-12 00:00:00") + f"""
SELECT {_M_COLS} FROM metrics m
WHERE NOT coalesce(m.period_start >= (SELECT lo FROM bounds b WHERE b.app_id = m.app_id)
              AND m.period_end <= (SELECT hi FROM bounds b WHERE b.app_id = m.app_id), false)
UNION ALL SELECT {_M_COLS} FROM staged""")
def q_metrics_range_replace_empty(v):
    """An empty refetch has no bounds and deletes nothing (B4 c)."""
    staged = metrics(v["request_logs"], ["requests"], since="2024-02-10T00:00:00Z",
                     until="2024-02-12T00:00:00Z", interval="day", group_by=["method"])
    out = range_replace(v["metrics"], align(staged, "metrics"))
    return out.select("app_id", "period_start", "period_end", "method", "path", "status_code",
                      "requests")


_AL_COLS = "app_id, request_uuid, timestamp, seq, message, level"


@query("q_replace_children", W("request_logs", "application_logs") + f"""
, parents AS (SELECT app_id, request_uuid FROM request_logs
              WHERE timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp < TIMESTAMP '2024-01-01 03:00:00'),
staged AS (SELECT a.app_id, a.request_uuid, a.timestamp, a.seq, concat('[refetched] ', a.message) AS message, a.level
           FROM application_logs a JOIN parents p USING (app_id, request_uuid) WHERE a.seq % 2 = 0)
SELECT {_AL_COLS} FROM application_logs a
WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.app_id = a.app_id AND p.request_uuid = a.request_uuid)
UNION ALL SELECT {_AL_COLS} FROM staged""")
def q_replace_children(v):
    """Children replace for application logs: parents refetched with fewer logs lose the
    old ones (B5)."""
    parents = _between(v["request_logs"], "timestamp", "2024-01-01T00:00:00Z", "2024-01-01T03:00:00Z") \
        .select("app_id", "request_uuid")
    logs = v["application_logs"].select("app_id", "request_uuid", "timestamp", "seq",
                                        "message", "level")
    staged = (logs.join(parents, ["app_id", "request_uuid"], "left_semi")
              .filter(F.col("seq") % 2 == 0).withColumn("message", F.concat(F.lit("[refetched] "), "message")))
    return replace_children(logs, staged, parents)


@query("q_upsert_latest_wins", W("request_logs") + f"""
, staged AS (SELECT * REPLACE (CASE WHEN k = 2 THEN 200 ELSE 599 - k END AS status_code)
             FROM request_logs, (SELECT 1 AS k UNION ALL SELECT 2 AS k) n WHERE timestamp >= TIMESTAMP '2024-01-20')
SELECT {_RL_SQL} FROM request_logs WHERE timestamp < TIMESTAMP '2024-01-20'
UNION ALL SELECT {_RL_SQL} FROM staged WHERE k = 2""")
def q_upsert_latest_wins(v):
    """Two fetches of one batch hold the same requests; the newer fetch's rows stay, though
    the older ones are greater (B1, M1)."""
    rl = v["request_logs"]
    staged = (_between(rl, "timestamp", lo="2024-01-20").withColumn("fetch", F.explode(F.array(F.lit(1), F.lit(2))))
              .withColumn("status_code", F.when(F.col("fetch") == 2, 200).otherwise(598)))
    return upsert(rl, staged, table="request_logs", newest=("fetch",)).select(*_RL_COLS)


@query("q_metrics_two_fetches", W("metrics") + """
, staged AS (SELECT app_id, period_start, period_end, method, path, status_code, requests + nth AS requests, nth
             FROM metrics, (SELECT 1 AS nth UNION ALL SELECT 2 AS nth) n
             WHERE (nth = 1 AND period_start >= TIMESTAMP '2024-01-05' AND period_end <= TIMESTAMP '2024-01-08')
                OR (nth = 2 AND period_start >= TIMESTAMP '2024-01-07' AND period_end <= TIMESTAMP '2024-01-11')),
bounds AS (SELECT app_id, nth, min(period_start) AS lo, max(period_end) AS hi FROM staged GROUP BY 1, 2)
SELECT app_id, period_start, period_end, method, path, status_code, CAST(requests AS BIGINT) AS requests FROM metrics m
WHERE NOT EXISTS (SELECT 1 FROM bounds b WHERE b.app_id = m.app_id AND m.period_start >= lo AND m.period_end <= hi)
UNION ALL
SELECT app_id, period_start, period_end, method, path, status_code, CAST(requests AS BIGINT) AS requests FROM staged s
WHERE NOT EXISTS (SELECT 1 FROM bounds b WHERE b.app_id = s.app_id AND b.nth > s.nth AND s.period_start >= lo AND s.period_end <= hi)""")
def q_metrics_two_fetches(v):
    """Two metrics fetches with overlapping ranges in one batch: each replaces its own range,
    the later one also the earlier's rows (B3, M1)."""
    m = v["metrics"].select("app_id", "period_start", "period_end", "method", "path", "status_code", "requests")
    staged = (m.withColumn("fetch", F.explode(F.array(F.lit(1), F.lit(2))))
              .filter(F.when(F.col("fetch") == 1, (F.col("period_start") >= ts_lit("2024-01-05")) & (F.col("period_end") <= ts_lit("2024-01-08")))
                      .otherwise((F.col("period_start") >= ts_lit("2024-01-07")) & (F.col("period_end") <= ts_lit("2024-01-11"))))
              .withColumn("requests", F.col("requests") + F.col("fetch")).withColumn("at", F.col("fetch")))
    return range_replace_fetches(m, staged, "fetch", ("at",))


@query("q_children_redelivered", W("request_logs", "application_logs") + f"""
SELECT {_AL_COLS} FROM application_logs""")
def q_children_redelivered(v):
    """Documents delivered twice in one batch: one document a request is chosen before its
    children are read, so the stored children do not double (B5, M1)."""
    logs = v["application_logs"].select("app_id", "request_uuid", "timestamp", "seq", "message", "level")
    docs = (logs.groupBy("app_id", "request_uuid").agg(F.collect_list(F.struct("timestamp", "seq", "message", "level")).alias("logs"))
            .withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))))
    one = dedup(docs, ["app_id", "request_uuid"], ("delivery",), clustered=True)
    staged = one.select("app_id", "request_uuid", F.explode("logs").alias("l")).select("app_id", "request_uuid", "l.*")
    return replace_children(logs, staged, one.select("app_id", "request_uuid"))
