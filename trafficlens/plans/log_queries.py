"""Catalog queries over the request-log query."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from trafficlens.functions.headers import headers_text, reshape_pairs
from trafficlens.operators.logs import consumers_since, endpoints_filter, request_logs
from trafficlens.plans.catalog import SINCE, UNTIL, W, query
from trafficlens.schemas import DEFAULT_LOG_FIELDS

DEFAULT_SQL = ", ".join(DEFAULT_LOG_FIELDS)
JAN = "timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31'"


def _logs_sql(where: str = "TRUE", fields: str = DEFAULT_SQL) -> str:
    return W("request_logs") + f"SELECT {fields} FROM request_logs WHERE {JAN} AND ({where})"


def _flt(name: str, filters: list[dict], where: str, doc: str):
    def fn(v):
        return request_logs(v["request_logs"], since=SINCE, until=UNTIL, filters=filters)
    fn.__doc__ = doc
    query(name, _logs_sql(where))(fn)


# One query per filter operator (E1-E22). Oracle WHERE clauses are written by hand.
_flt("q_f_eq", [{"field": "path", "op": "eq", "value": "/v1/accounts/{account_id}"}],
     "path = '/v1/accounts/{account_id}'", "eq on a string field (E1).")
_flt("q_f_neq", [{"field": "method", "op": "neq", "value": "GET"}],
     "method <> 'GET'", "neq (E2).")
_flt("q_f_gt", [{"field": "response_time_ms", "op": "gt", "value": 50}],
     "response_time_ms > 50", "gt on an int field (E3).")
_flt("q_f_gte", [{"field": "status_code", "op": "gte", "value": 400}],
     "status_code >= 400", "gte (E4).")
_flt("q_f_lt", [{"field": "response_size_bytes", "op": "lt", "value": 100}],
     "response_size_bytes < 100", "lt (E5).")
_flt("q_f_lte", [{"field": "request_size_bytes", "op": "lte", "value": 9}],
     "request_size_bytes <= 9", "lte (E6).")
_flt("q_f_in", [{"field": "status_code", "op": "in", "value": [404, 422, 500]}],
     "status_code IN (404, 422, 500)", "in (E7).")
_flt("q_f_not_in", [{"field": "method", "op": "not_in", "value": ["GET", "PUT"]}],
     "method NOT IN ('GET', 'PUT')", "not_in (E8).")
_flt("q_f_like", [{"field": "url", "op": "like", "value": "%?u=1%"}],
     "url LIKE '%?u=1%'", "like, case-sensitive, % wildcard (E9).")
_flt("q_f_like_escape", [{"field": "path", "op": "like", "value": "/v1/accounts/{account\\_id}"}],
     "path LIKE '/v1/accounts/{account\\_id}'", "A backslash in a pattern is literal (E9 trap).")
_flt("q_f_not_like", [{"field": "path", "op": "not_like", "value": "/v1/items%"}],
     "path NOT LIKE '/v1/items%'", "not_like (E10).")
_flt("q_f_ilike", [{"field": "url", "op": "ilike", "value": "%/R/1%"}],
     "url ILIKE '%/R/1%'", "ilike (E11).")
_flt("q_f_not_ilike", [{"field": "path", "op": "not_ilike", "value": "%ITEMS%"}],
     "path NOT ILIKE '%ITEMS%'", "not_ilike (E12).")
_flt("q_f_contains", [{"field": "exception_message", "op": "contains", "value": "SHELF"}],
     "contains(lower(exception_message), 'shelf')", "contains is case-insensitive (E13).")
_flt("q_f_not_contains", [{"field": "env", "op": "not_contains", "value": "DEV"}],
     "NOT contains(lower(env), 'dev')", "not_contains (E14).")
_flt("q_f_is_null", [{"field": "consumer_id", "op": "is_null"}],
     "consumer_id IS NULL", "is_null (E15).")
_flt("q_f_is_not_null", [{"field": "exception_type", "op": "is_not_null"}],
     "exception_type IS NOT NULL", "is_not_null (E16).")
_HDR = "[s FOR s IN {h} IF lower(s.name) = '{k}'{cond}]"


def _hdr_any(h, k, cond=""):
    return f"coalesce(len({_HDR.format(h=h, k=k, cond=cond)}) > 0, false)"


_flt("q_f_hdr_exists", [{"field": "request_headers", "key": "Authorization", "op": "exists"}],
     _hdr_any("request_headers", "authorization"), "Header exists, name case-insensitive (E17).")
_flt("q_f_hdr_not_exists",
     [{"field": "request_headers", "key": "authorization", "op": "not_exists"}],
     "NOT " + _hdr_any("request_headers", "authorization"), "Header not_exists (E18).")
_flt("q_f_hdr_value",
     [{"field": "request_headers", "key": "content-type", "op": "eq", "value": "application/json"}],
     _hdr_any("request_headers", "content-type", " AND s.value = 'application/json'"),
     "Header value eq (E19).")
_flt("q_f_hdr_value_neg",
     [{"field": "request_headers", "key": "X-TAG", "op": "not_in", "value": ["v2"]}],
     "NOT " + _hdr_any("request_headers", "x-tag", " AND s.value IN ('v2')"),
     "Negative header value op = NOT of the positive one, repeated names (E19).")
_flt("q_f_hdr_like",
     [{"field": "response_headers", "key": "x-request-id", "op": "like", "value": "req-00000000001%"}],
     _hdr_any("response_headers", "x-request-id", " AND s.value LIKE 'req-00000000001%'"),
     "Header value like (E19).")
_flt("q_f_hdr_contains",
     [{"field": "request_headers", "key": "x-tag", "op": "not_contains", "value": "CLICK"}],
     "NOT " + _hdr_any("request_headers", "x-tag", " AND contains(lower(s.value), 'click')"),
     "Header value not_contains (E19).")
_flt("q_f_datetime", [{"field": "timestamp", "op": "gte", "value": "2024-01-10T00:00:00Z"},
                      {"field": "timestamp", "op": "lt", "value": "2024-01-12T12:00:00"}],
     "timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-12 12:00:00'",
     "Datetime ops with ISO values (E20).")
# The header value operators and datetime operators that the queries above leave.
for _op, _value, _cond in [
        ("neq", "v2", "NOT {any = 'v2'}"), ("in", ["v2", "view"], "{any IN ('v2', 'view')}"),
        ("not_like", "cl%", "NOT {any LIKE 'cl%'}"), ("ilike", "CL%", "{any ILIKE 'CL%'}"),
        ("not_ilike", "%ICK", "NOT {any ILIKE '%ICK'}"), ("contains", "ERR", "{any contains}")]:
    _neg, _test = _cond.startswith("NOT "), _cond.removeprefix("NOT ").strip("{}").removeprefix("any ")
    _test = "contains(lower(s.value), 'err')" if _test == "contains" else f"s.value {_test}"
    _flt(f"q_f_hdr_{_op}_value", [{"field": "request_headers", "key": "x-tag", "op": _op, "value": _value}],
         ("NOT " if _neg else "") + _hdr_any("request_headers", "x-tag", f" AND {_test}"), f"Header value {_op} (E19).")
for _op, _sign, _at in [("eq", "=", "2024-01-01T00:00:07.179575"), ("neq", "<>", "2024-01-01T00:00:07.179575"),
                        ("gt", ">", "2024-01-10T00:00:00"), ("lte", "<=", "2024-01-10T00:00:00")]:
    _flt(f"q_f_datetime_{_op}", [{"field": "timestamp", "op": _op, "value": _at + "Z"}],
         f"timestamp {_sign} TIMESTAMP '{_at}'", f"Datetime {_op} (E20).")
_flt("q_f_body_contains", [{"field": "response_body_json", "op": "contains", "value": '"FAILED"'}],
     "contains(lower(response_body_json), '\"failed\"')", "String op on a JSON body (E21).")
_flt("q_f_and", [{"field": "status_code", "op": "gte", "value": 400},
                 {"field": "status_code", "op": "lt", "value": 500},
                 {"field": "method", "op": "eq", "value": "GET"},
                 {"field": "consumer_id", "op": "neq", "value": 7}],
     "status_code >= 400 AND status_code < 500 AND method = 'GET' AND consumer_id <> 7",
     "AND of several filters (E22).")


@query("q_logs_fields", _logs_sql(
    "TRUE", "timestamp, request_uuid, method, url, status_code, response_body_json, exception_type"))
def q_logs_fields(v):
    """Field selection (C1) with the always-included fields."""
    return request_logs(v["request_logs"], since=SINCE, until=UNTIL,
                        fields=["exception_type", "status_code", "response_body_json"])


@query("q_logs_default_fields", _logs_sql())
def q_logs_default_fields(v):
    """The 13 default fields."""
    return request_logs(v["request_logs"], since=SINCE, until=UNTIL)


@query("q_logs_min_fields", _logs_sql("TRUE", "timestamp, request_uuid, env, method, url"))
def q_logs_min_fields(v):
    """Asking for one field still returns timestamp, request_uuid, method, url."""
    return request_logs(v["request_logs"], since=SINCE, until=UNTIL, fields=["env"])


_NO_HEADERS = "* EXCLUDE (request_headers, response_headers)"


@query("q_exclude", W("request_logs") + f"SELECT {_NO_HEADERS} FROM request_logs")
def q_exclude(v):
    """SELECT * EXCLUDE."""
    return v["request_logs"].drop("request_headers", "response_headers")


@query("q_replace_col", W("request_logs") +
       f"SELECT {_NO_HEADERS} REPLACE (lower(method) AS method, response_time_ms * 1000 AS response_time_ms) "
       "FROM request_logs")
def q_replace_col(v):
    """SELECT * REPLACE."""
    return (v["request_logs"].drop("request_headers", "response_headers")
            .withColumn("method", F.lower("method"))
            .withColumn("response_time_ms", F.col("response_time_ms") * 1000))


@query("q_headers_reshape", W("request_logs") + """
SELECT request_uuid,
       array_to_string([concat_ws('=', s.name, s.value) FOR s IN request_headers], '|') AS request_headers,
       len(request_headers) AS n_headers
FROM request_logs""")
def q_headers_reshape(v):
    """Wire-shaped STRUCT("1","2")[] headers reshaped to STRUCT(name, value)[]."""
    wire = v["request_logs"].select(
        "request_uuid",
        F.transform("request_headers", lambda x: F.struct(x["name"].alias("1"),
                                                           x["value"].alias("2"))).alias("wire"))
    h = reshape_pairs(F.col("wire"))
    return wire.select("request_uuid", headers_text(h).alias("request_headers"),
                       F.when(h.isNotNull(), F.size(h)).cast("bigint").alias("n_headers"))


@query("q_logs_sorted", _logs_sql("status_code >= 500"))
def q_logs_sorted(v):
    """Ordered by timestamp ascending, request_uuid breaking ties."""
    return request_logs(v["request_logs"], since=SINCE, until=UNTIL,
                        filters=[{"field": "status_code", "op": "gte", "value": 500}])


@query("q_logs_limit", W("request_logs") + f"""
SELECT {DEFAULT_SQL} FROM request_logs WHERE {JAN} AND status_code >= 400
ORDER BY timestamp, request_uuid LIMIT 100""")
def q_logs_limit(v):
    """limit n after the time order."""
    return request_logs(v["request_logs"], since=SINCE, until=UNTIL, limit=100,
                        filters=[{"field": "status_code", "op": "gte", "value": 400}])


@query("q_logs_sample_rate", _logs_sql("substr(md5(request_uuid), 1, 15) < '1999999999999a0'"))
def q_logs_sample_rate(v):
    """Deterministic hash sample at rate 0.1 (I4)."""
    return request_logs(v["request_logs"], since=SINCE, until=UNTIL, sample_rate=0.1)


@query("q_logs_sample_size", W("request_logs") + f"""
, f AS (SELECT * FROM request_logs WHERE {JAN} AND method = 'GET'),
r AS (SELECT least(1.0::DOUBLE, 500 / (SELECT count(*) FROM f)) AS rate)
SELECT {DEFAULT_SQL} FROM f
WHERE (SELECT rate FROM r) >= 1.0
   OR substr(md5(request_uuid), 1, 15) <
      lpad(lower(hex(CAST(floor((SELECT rate FROM r) * 1152921504606846976.0) AS BIGINT))), 15, '0')""")
def q_logs_sample_size(v):
    """Approximate sample of about 500 rows: rate = 500 / filtered count."""
    return request_logs(v["request_logs"], since=SINCE, until=UNTIL, sample_size=500,
                        filters=[{"field": "method", "op": "eq", "value": "GET"}])


@query("q_logs_range", W("request_logs") + f"""
SELECT {DEFAULT_SQL} FROM request_logs
WHERE timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp < TIMESTAMP '2024-01-09 00:00:00'""")
def q_logs_range(v):
    """since inclusive, until exclusive; zone-less values are UTC (D3)."""
    return request_logs(v["request_logs"], since="2024-01-05T06:00:00",
                        until="2024-01-09T00:00:00Z")


@query("q_logs_last_7d", W("request_logs") + f"""
SELECT {DEFAULT_SQL} FROM request_logs
WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00' AND timestamp < TIMESTAMP '2024-01-31 00:00:00'""")
def q_logs_last_7d(v):
    """Relative range '7d' before a fixed now; until defaults to now."""
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    return request_logs(v["request_logs"], since="7d", now=now)


@query("q_top_errors", W("request_logs") + f"""
SELECT path, status_code, CAST(count(*) AS BIGINT) AS n FROM request_logs
WHERE {JAN} AND status_code >= 400 GROUP BY ALL ORDER BY n DESC, path, status_code LIMIT 3""")
def q_top_errors(v):
    """Top-k errors: ORDER BY n DESC LIMIT k with tie-breakers."""
    d = request_logs(v["request_logs"], since=SINCE, until=UNTIL, ordered=False,
                     fields=["path", "status_code"],
                     filters=[{"field": "status_code", "op": "gte", "value": 400}])
    return (d.groupBy("path", "status_code").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "path", "status_code").limit(3))


@query("q_endpoints_filter", W("endpoints") + """
SELECT app_id, endpoint_id, method, path FROM endpoints
WHERE upper(method) IN ('GET', 'POST') AND path LIKE '/v1/%items%'""")
def q_endpoints_filter(v):
    """Endpoints by method list and * wildcard path."""
    return endpoints_filter(v["endpoints"], method="get, post", path="/v1/*items*")


@query("q_endpoints_sorted", W("endpoints") + "SELECT app_id, endpoint_id, method, path FROM endpoints")
def q_endpoints_sorted(v):
    """Endpoints ordered by path and method."""
    return endpoints_filter(v["endpoints"])


@query("q_consumers_since", W("consumers") + """
SELECT * FROM consumers WHERE last_request_at >= TIMESTAMP '2024-01-29 12:00:00'""")
def q_consumers_since(v):
    """Consumers active since a relative time."""
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    return consumers_since(v["consumers"], "36h", now=now)


@query("q_request_lookup", W("request_logs") + f"""
SELECT {DEFAULT_SQL} FROM request_logs WHERE app_id = 3 AND request_uuid = 'req-000000004242'""")
def q_request_lookup(v):
    """Point lookup by (app_id, request_uuid)."""
    return request_logs(v["request_logs"], app_id=3, filters=[
        {"field": "request_uuid", "op": "eq", "value": "req-000000004242"}])


@query("q_scope", W("request_logs") + f"""
SELECT {DEFAULT_SQL} FROM request_logs
WHERE app_id IN (1, 2, 3) AND timestamp >= TIMESTAMP '2024-01-15' AND timestamp < TIMESTAMP '2024-01-31'""")
def q_scope(v):
    """Scope by app and time on every query over the store."""
    return request_logs(v["request_logs"], app_id=[1, 2, 3], since="2024-01-15", until=UNTIL)
