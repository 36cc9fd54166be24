"""Catalog queries over JSON bodies and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions import headers as H
from trafficlens.functions import json as J
from trafficlens.operators.logs import request_logs
from trafficlens.plans.catalog import SINCE, UNTIL, W, query

RB = "response_body_json"
JAN = "timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31'"


def _rl(v):
    return v["request_logs"]


def _joined(c, sep=","):
    """Lists are compared as joined text (NULL elements shown as a marker)."""
    return F.array_join(c, sep, "<null>")


def _duck_joined(expr, sep=","):
    return f"array_to_string(list_transform({expr}, lambda x: coalesce(CAST(x AS VARCHAR), '<null>')), '{sep}')"


@query("q_json_exists", W("request_logs") + f"""
SELECT request_uuid, json_exists({RB}, '$.error') AS has_error,
       json_exists({RB}, '$.items[1]') AS has_second_item,
       json_exists(request_body_json, '$.k') AS has_k
FROM request_logs""")
def q_json_exists(v):
    """json_exists (K1)."""
    return _rl(v).select("request_uuid", J.json_exists(RB, "$.error").alias("has_error"),
                         J.json_exists(RB, "$.items[1]").alias("has_second_item"),
                         J.json_exists("request_body_json", "$.k").alias("has_k"))


@query("q_json_extract", W("request_logs") + f"""
SELECT request_uuid, CAST({RB} -> '$.items' AS VARCHAR) AS items,
       CAST({RB} -> '$.status' AS VARCHAR) AS status_json,
       CAST(request_body_json -> '$.k' AS VARCHAR) AS k_json
FROM request_logs""")
def q_json_extract(v):
    """json_extract / -> keeps JSON (strings quoted) (K2)."""
    return _rl(v).select("request_uuid", J.json_extract(RB, "$.items").alias("items"),
                         J.json_extract(RB, "$.status").alias("status_json"),
                         J.json_extract("request_body_json", "$.k").alias("k_json"))


@query("q_json_extract_string", W("request_logs") + f"""
SELECT request_uuid, ({RB} ->> '$.error') AS error, ({RB} ->> '$.status') AS status,
       ({RB} ->> '$.items') AS items_text
FROM request_logs""")
def q_json_extract_string(v):
    """json_extract_string / ->> (K3)."""
    return _rl(v).select("request_uuid", J.json_extract_string(RB, "$.error").alias("error"),
                         J.json_extract_string(RB, "$.status").alias("status"),
                         J.json_extract_string(RB, "$.items").alias("items_text"))


@query("q_json_extract_many", W("request_logs") + f"""
SELECT request_uuid, {_duck_joined(f"json_extract_string({RB}, ['$.status', '$.error', '$.items[0].id'])", '|')} AS parts
FROM request_logs""")
def q_json_extract_many(v):
    """->> with a list of paths gives a list (K4)."""
    return _rl(v).select("request_uuid", _joined(
        J.json_extract_many(RB, ["$.status", "$.error", "$.items[0].id"]), "|").alias("parts"))


@query("q_json_value", W("request_logs") + f"""
SELECT request_uuid, CAST(json_value({RB}, '$.status') AS VARCHAR) AS status_value,
       CAST(json_value({RB}, '$.items') AS VARCHAR) AS items_value,
       CAST(json_value(request_body_json, '$.k') AS VARCHAR) AS k_value
FROM request_logs""")
def q_json_value(v):
    """json_value: NULL unless a scalar (K5)."""
    return _rl(v).select("request_uuid", J.json_value(RB, "$.status").alias("status_value"),
                         J.json_value(RB, "$.items").alias("items_value"),
                         J.json_value("request_body_json", "$.k").alias("k_value"))


@query("q_jsonpath", W("request_logs") + f"""
SELECT request_uuid, ({RB} ->> '$.items[0].id') AS first_id,
       ({RB} ->> '$.items[1].status') AS second_status, ({RB} ->> '$.items[0]') AS first_item
FROM request_logs""")
def q_jsonpath(v):
    """JSONPath $.a, $.a[0], $.a[0].b (K6)."""
    return _rl(v).select("request_uuid",
                         J.json_extract_string(RB, "$.items[0].id").alias("first_id"),
                         J.json_extract_string(RB, "$.items[1].status").alias("second_status"),
                         J.json_extract_string(RB, "$.items[0]").alias("first_item"))


@query("q_jsonpath_last", W("request_logs") + f"""
SELECT request_uuid, ({RB} ->> '$.items[#-1]') AS last_item FROM request_logs""")
def q_jsonpath_last(v):
    """JSONPath [#-1], the last element (K7)."""
    return _rl(v).select("request_uuid", J.json_last(RB, "$.items").alias("last_item"))


@query("q_jsonpath_all", W("request_logs") + f"""
SELECT request_uuid, {_duck_joined(f"({RB} ->> '$.items[*].id')")} AS ids,
       {_duck_joined(f"({RB} ->> '$.items[*]')", '|')} AS items
FROM request_logs""")
def q_jsonpath_all(v):
    """JSONPath [*] gives a list, [] when nothing matches (K8)."""
    return _rl(v).select("request_uuid", _joined(J.json_all(RB, "$.items", "id")).alias("ids"),
                         _joined(J.json_all(RB, "$.items"), "|").alias("items"))


@query("q_json_chain", W("request_logs") + f"""
SELECT request_uuid, ({RB} -> '$.items' ->> 0) AS first_item,
       ({RB} -> '$.items' -> '$[1]' ->> '$.id') AS second_id
FROM request_logs""")
def q_json_chain(v):
    """Chained extraction ->'$.items'->>0 (K9)."""
    items = J.json_extract(RB, "$.items")
    return _rl(v).select("request_uuid",
                         J.json_extract_string(items, "$[0]").alias("first_item"),
                         J.json_extract_string(J.json_extract(items, "$[1]"), "$.id").alias("second_id"))


@query("q_json_array_length", W("request_logs") + f"""
SELECT request_uuid, CAST(json_array_length({RB}, '$.items') AS BIGINT) AS n_items,
       CAST(json_array_length({RB}, '$.status') AS BIGINT) AS n_status,
       CAST(json_array_length({RB}, '$.nope') AS BIGINT) AS n_missing,
       CAST(json_array_length({RB}) AS BIGINT) AS n_root
FROM request_logs""")
def q_json_array_length(v):
    """json_array_length: 0 for non-arrays, NULL for a missing path."""
    return _rl(v).select("request_uuid", J.json_array_length(RB, "$.items").alias("n_items"),
                         J.json_array_length(RB, "$.status").alias("n_status"),
                         J.json_array_length(RB, "$.nope").alias("n_missing"),
                         J.json_array_length(RB).alias("n_root"))


@query("q_json_contains", W("request_logs") + f"""
SELECT request_uuid, json_contains({RB}, '{{"status":"failed"}}') AS has_failed,
       json_contains({RB}, '"ok"') AS has_ok, json_contains({RB}, '{{"items":[]}}') AS has_items,
       json_contains({RB}, '"E1"') AS is_e1
FROM request_logs""")
def q_json_contains(v):
    """json_contains at any depth, order-free arrays, whole strings."""
    hits = J.json_contains_many(RB, ['{"status":"failed"}', '"ok"', '{"items":[]}', '"E1"'])
    d = _rl(v).select("request_uuid", hits.alias("_hits"))
    return d.select("request_uuid", *[F.col("_hits")[i].alias(n) for i, n in
                                      enumerate(["has_failed", "has_ok", "has_items", "is_e1"])])


@query("q_json_keys", W("request_logs") + f"""
SELECT request_uuid, array_to_string(json_keys({RB}), ',') AS keys,
       array_to_string(json_keys({RB}, '$.items[0]'), ',') AS item_keys,
       array_to_string(json_keys({RB}, '$.items'), ',') AS array_keys
FROM request_logs""")
def q_json_keys(v):
    """json_keys; [] for non-objects."""
    return _rl(v).select("request_uuid", F.array_join(J.json_keys(RB), ",").alias("keys"),
                         F.array_join(J.json_keys(RB, "$.items[0]"), ",").alias("item_keys"),
                         F.array_join(J.json_keys(RB, "$.items"), ",").alias("array_keys"))


@query("q_json_type", W("request_logs") + f"""
SELECT request_uuid, json_type({RB}) AS t_root, json_type({RB}, '$.items') AS t_items,
       json_type({RB}, '$.status') AS t_status, json_type({RB}, '$.items[0].id') AS t_id,
       json_type(request_body_json, '$.k') AS t_k, json_type({RB}, '$.nope') AS t_missing
FROM request_logs""")
def q_json_type(v):
    """json_type names."""
    return _rl(v).select("request_uuid", J.json_type(RB).alias("t_root"),
                         J.json_type(RB, "$.items").alias("t_items"),
                         J.json_type(RB, "$.status").alias("t_status"),
                         J.json_type(RB, "$.items[0].id").alias("t_id"),
                         J.json_type("request_body_json", "$.k").alias("t_k"),
                         J.json_type(RB, "$.nope").alias("t_missing"))


@query("q_json_items", W("request_logs") + f"""
SELECT logs.request_uuid, logs.method, logs.path, CAST(entry.key AS VARCHAR) AS entry_no,
       entry.value ->> '$.id' AS entry_id, entry.value ->> '$.status' AS entry_status,
       entry.type AS entry_type
FROM request_logs AS logs, json_each(logs.{RB}, '$.items') AS entry
WHERE logs.{RB} IS NOT NULL AND {JAN.replace('timestamp', 'logs.timestamp')}""")
def q_json_items(v):
    """Items unnested with the json_each table function."""
    d = request_logs(_rl(v), since=SINCE, until=UNTIL, ordered=False,
                     fields=["path", "response_body_json"],
                     filters=[{"field": RB, "op": "is_not_null"}])
    e = J.json_each(d, RB, "$.items", alias="entry", texts=False)
    return e.select("request_uuid", "method", "path", F.col("entry.key").alias("entry_no"),
                    J.variant_text(F.col("entry.v"), "$.id").alias("entry_id"),
                    J.variant_text(F.col("entry.v"), "$.status").alias("entry_status"),
                    F.col("entry.type").alias("entry_type"))


@query("q_failed_items", W("request_logs") + f"""
, entries AS (SELECT logs.request_uuid, logs.method, logs.path, entry.value ->> '$.status' = 'failed' AS bad
              FROM request_logs AS logs, json_each(logs.{RB}, '$.items') AS entry
              WHERE logs.{RB} IS NOT NULL AND {JAN.replace('timestamp', 'logs.timestamp')})
SELECT request_uuid, method, path, CAST(count(*) AS BIGINT) AS n_entries, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_bad
FROM entries GROUP BY request_uuid, method, path HAVING n_bad > 0""")
def q_failed_items(v):
    """Failed items per request: conditional sum + HAVING on an alias."""
    entries = q_json_items(v)
    return (entries.groupBy("request_uuid", "method", "path")
            .agg(F.count(F.lit(1)).alias("n_entries"),
                 F.sum(F.when(F.col("entry_status") == "failed", 1).otherwise(0))
                 .cast("bigint").alias("n_bad"))
            .filter(F.col("n_bad") > 0))


@query("q_body_error", W("request_logs") + f"""
SELECT timestamp, method, path, ({RB} ->> '$.error') AS error_message
FROM request_logs
WHERE {JAN} AND {RB} IS NOT NULL AND ({RB} ->> '$.error') IS NOT NULL""")
def q_body_error(v):
    """Requests whose body carries an error message."""
    d = request_logs(_rl(v), since=SINCE, until=UNTIL, fields=["path", RB],
                     filters=[{"field": RB, "op": "is_not_null"}])
    return (d.select("timestamp", "method", "path",
                     J.json_extract_string(RB, "$.error").alias("error_message"))
            .filter(F.col("error_message").isNotNull()))


@query("q_body_error_codes", W("request_logs") + f"""
SELECT ({RB} ->> '$.error') AS error_code, method, path, status_code, CAST(count(*) AS BIGINT) AS n
FROM request_logs WHERE {JAN} AND ({RB} ->> '$.error') IS NOT NULL
GROUP BY ALL""")
def q_body_error_codes(v):
    """Requests by body error code."""
    d = _rl(v).filter((F.col("timestamp") >= F.lit(SINCE).cast("timestamp")) &
                      (F.col("timestamp") < F.lit(UNTIL).cast("timestamp")))
    d = d.select(J.json_extract_string(RB, "$.error").alias("error_code"), "method", "path",
                 "status_code").filter(F.col("error_code").isNotNull())
    return d.groupBy("error_code", "method", "path", "status_code").agg(
        F.count(F.lit(1)).alias("n"))


@query("q_big_arrays", W("request_logs") + f"""
SELECT timestamp, method, path, CAST(json_array_length({RB}, '$.items') AS BIGINT) AS item_count
FROM request_logs WHERE {JAN} AND json_array_length({RB}, '$.items') > 1""")
def q_big_arrays(v):
    """Responses whose items array is longer than N."""
    d = request_logs(_rl(v), since=SINCE, until=UNTIL, fields=["path", RB], ordered=False)
    return (d.select("timestamp", "method", "path",
                     J.json_array_length(RB, "$.items").alias("item_count"))
            .filter(F.col("item_count") > 1))


@query("q_body_key_shapes", W("request_logs") + f"""
SELECT array_to_string(json_keys({RB}), ',') AS keys, CAST(COUNT(*) AS BIGINT) AS n
FROM request_logs WHERE {JAN} AND {RB} IS NOT NULL
GROUP BY json_keys({RB}) ORDER BY n DESC, keys LIMIT 10""")
def q_body_key_shapes(v):
    """Top-level key shapes of bodies, grouped by an array value, top 10."""
    d = request_logs(_rl(v), since=SINCE, until=UNTIL, fields=[RB], ordered=False,
                     filters=[{"field": RB, "op": "is_not_null"}])
    g = d.groupBy(J.json_keys(RB).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return (g.select(F.array_join("k", ",").alias("keys"), "n")
            .orderBy(F.col("n").desc(), "keys").limit(10))


@query("q_header_value", W("request_logs") + f"""
SELECT request_uuid, timestamp, method, path,
       [s.value FOR s IN request_headers IF lower(s.name) = 'content-type'][1] AS content_type,
       array_to_string([s.value FOR s IN request_headers IF lower(s.name) = 'x-tag'], ',') AS tags
FROM request_logs WHERE {JAN} AND request_headers IS NOT NULL""")
def q_header_value(v):
    """Header value by case-insensitive name: filtered comprehension, 1-based [1]."""
    d = _rl(v).filter(F.col("request_headers").isNotNull() &
                      (F.col("timestamp") >= F.lit(SINCE).cast("timestamp")) &
                      (F.col("timestamp") < F.lit(UNTIL).cast("timestamp")))
    return d.select("request_uuid", "timestamp", "method", "path",
                    H.header_value("request_headers", "Content-Type").alias("content_type"),
                    F.array_join(H.header_values("request_headers", "x-tag"), ",").alias("tags"))


@query("q_header_exists", W("request_logs") + f"""
SELECT request_uuid, timestamp, method, path,
       len([s FOR s IN request_headers IF lower(s.name) = 'authorization']) AS n_auth
FROM request_logs
WHERE {JAN} AND len([s FOR s IN request_headers IF lower(s.name) = 'authorization']) > 0""")
def q_header_exists(v):
    """Header presence with len() of a filtered list."""
    d = _rl(v).filter((F.col("timestamp") >= F.lit(SINCE).cast("timestamp")) &
                      (F.col("timestamp") < F.lit(UNTIL).cast("timestamp")))
    return (d.select("request_uuid", "timestamp", "method", "path",
                     H.header_count("request_headers", "authorization").alias("n_auth"))
            .filter(F.col("n_auth") > 0))
