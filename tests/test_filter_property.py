"""Property test: random filter lists give the same rows in Spark (our compiler) as in
DuckDB (a test-only SQL rendering of the documented semantics) on the sf0.001 logs."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trafficlens.operators.filters import apply_filters
from trafficlens.sources.testtables import oracle_with, register_views

SF = "/root/testdata/sf0.001"

STRING_FIELDS = {"env": ["prod", "dev", "PRO"], "method": ["GET", "POST", "put"],
                 "path": ["/v1/items", "/v1/accounts/{account_id}", "/v1/orders"],
                 "client_country_iso_code": ["DE", "us", "AU"],
                 "exception_type": ["StockMismatch", "stock"]}
PATTERNS = ["/v1/%", "%items%", "%ACCOUNTS%", "/v1/accounts/{account\\_id}", "%"]
INT_FIELDS = {"status_code": [200, 201, 404, 422, 500], "response_time_ms": [0, 5, 20, 50],
              "request_size_bytes": [8, 9, 10]}


def q(v):
    return "'" + str(v).replace("'", "''") + "'"


@st.composite
def a_filter(draw):
    kind = draw(st.sampled_from(["str", "int", "null", "hdr", "ts"]))
    if kind == "str":
        f = draw(st.sampled_from(sorted(STRING_FIELDS)))
        op = draw(st.sampled_from(["eq", "neq", "in", "not_in", "like", "not_like", "ilike",
                                   "not_ilike", "contains", "not_contains"]))
        vals = STRING_FIELDS[f]
        if op in ("in", "not_in"):
            v = draw(st.lists(st.sampled_from(vals), min_size=1, max_size=3))
            sql = f"{f} {'NOT ' if op == 'not_in' else ''}IN ({', '.join(q(x) for x in v)})"
        elif op in ("like", "not_like", "ilike", "not_ilike"):
            v = draw(st.sampled_from(PATTERNS + vals))
            kw = "ILIKE" if "ilike" in op else "LIKE"
            sql = f"{f} {'NOT ' if op.startswith('not') else ''}{kw} {q(v)}"
        elif op in ("contains", "not_contains"):
            v = draw(st.sampled_from(vals))
            sql = f"{'NOT ' if op == 'not_contains' else ''}contains(lower({f}), lower({q(v)}))"
        else:
            v = draw(st.sampled_from(vals))
            sql = f"{f} {'=' if op == 'eq' else '<>'} {q(v)}"
        return {"field": f, "op": op, "value": v}, sql
    if kind == "int":
        f = draw(st.sampled_from(sorted(INT_FIELDS)))
        op = draw(st.sampled_from(["eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in"]))
        if op in ("in", "not_in"):
            v = draw(st.lists(st.sampled_from(INT_FIELDS[f]), min_size=1, max_size=3))
            return {"field": f, "op": op, "value": v}, \
                f"{f} {'NOT ' if op == 'not_in' else ''}IN ({', '.join(map(str, v))})"
        v = draw(st.sampled_from(INT_FIELDS[f]))
        sym = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[op]
        return {"field": f, "op": op, "value": v}, f"{f} {sym} {v}"
    if kind == "null":
        f = draw(st.sampled_from(["consumer_id", "exception_type", "sentry_event_id", "env"]))
        op = draw(st.sampled_from(["is_null", "is_not_null"]))
        return {"field": f, "op": op}, f"{f} IS {'NOT ' if op == 'is_not_null' else ''}NULL"
    if kind == "ts":
        op = draw(st.sampled_from(["gt", "gte", "lt", "lte", "neq"]))
        day = draw(st.integers(min_value=1, max_value=30))
        v = f"2024-01-{day:02d}T12:00:00Z"
        sym = {"neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[op]
        return {"field": "timestamp", "op": op, "value": v}, \
            f"timestamp {sym} TIMESTAMP '2024-01-{day:02d} 12:00:00'"
    h = draw(st.sampled_from(["request_headers", "response_headers"]))
    key = draw(st.sampled_from(["content-type", "X-TAG", "authorization", "x-request-id"]))
    op = draw(st.sampled_from(["exists", "not_exists", "eq", "neq", "contains", "not_contains",
                               "like", "not_ilike"]))
    comp = f"[s FOR s IN {h} IF lower(s.name) = {q(key.lower())}{{c}}]"
    if op in ("exists", "not_exists"):
        sql = f"coalesce(len({comp.format(c='')}) > 0, false)"
        return {"field": h, "key": key, "op": op}, ("NOT " if op == "not_exists" else "") + sql
    v = draw(st.sampled_from(["application/json", "v2", "click", "req-0000000001%", "%JSON%"]))
    pos = {"eq": "s.value = {v}", "neq": "s.value = {v}", "contains": "contains(lower(s.value), lower({v}))",
           "not_contains": "contains(lower(s.value), lower({v}))", "like": "s.value LIKE {v}",
           "not_ilike": "s.value ILIKE {v}"}[op].format(v=q(v))
    sql = f"coalesce(len({comp.format(c=' AND ' + pos)}) > 0, false)"
    neg = op in ("neq", "not_contains", "not_ilike")
    return {"field": h, "key": key, "op": op, "value": v}, ("NOT " if neg else "") + sql


@pytest.fixture(scope="module")
def env(spark):
    con = duckdb.connect()
    for t in ["region", "customer", "events", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return register_views(spark, SF)["request_logs"], con


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(a_filter(), min_size=1, max_size=3))
def test_filters_match_duckdb(env, flts):
    rl, con = env
    filters = [f for f, _ in flts]
    where = " AND ".join(f"({s})" for _, s in flts)
    got = sorted(r.request_uuid for r in apply_filters(rl, filters).select("request_uuid").collect())
    exp = sorted(r[0] for r in con.execute(
        oracle_with("request_logs") + f"SELECT request_uuid FROM request_logs WHERE {where}").fetchall())
    assert got == exp, (filters, where)
