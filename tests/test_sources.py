import json
import os

import pyarrow as pa
import pytest

from trafficlens.sources.arrow_stream import read_arrow_streams
from trafficlens.sources.pages import (read_apps, read_consumers, read_endpoints,
                                       read_metrics_ndjson, read_request_details,
                                       read_request_logs_ndjson)
from trafficlens.functions.headers import reshape_pairs
from pyspark.sql import functions as F


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_apps_page(spark, workdir):
    page = {"data": [{"id": 31, "name": "Billing", "framework": "Django", "client_id": "k-77",
                      "envs": [{"id": 310, "name": "live", "created_at": "2025-01-01T00:00:00Z",
                                "last_sync_at": "2025-01-02T00:00:00Z"},
                               {"id": 311, "name": "stage", "created_at": "2025-01-01T00:00:00Z",
                                "last_sync_at": None}],
                      "created_at": "2025-01-01T00:00:00Z"}]}
    apps, envs = read_apps(spark, _write(workdir, "apps.json", json.dumps(page)))
    assert [(r.app_id, r.name, r.framework) for r in apps.collect()] == [(31, "Billing", "Django")]
    e = sorted((r.app_env_id, r.name, r.last_sync_at is None) for r in envs.collect())
    assert e == [(310, "live", False), (311, "stage", True)]


def test_consumer_pages_flatten_group(spark, workdir):
    p1 = {"data": [{"id": 71, "identifier": "kim@shop.example", "name": "Kim", "group": None,
                    "created_at": "2025-01-01T00:00:00Z", "last_request_at": "2025-01-02T00:00:00Z"}],
          "has_more": True, "next_token": "p2"}
    p2 = {"data": [{"id": 72, "identifier": "lee@shop.example", "name": "Lee",
                    "group": {"id": 9, "name": "Wholesale"},
                    "created_at": "2025-01-01T00:00:00Z", "last_request_at": None}],
          "has_more": False, "next_token": None}
    paths = [_write(workdir, "c1.json", json.dumps(p1)), _write(workdir, "c2.json", json.dumps(p2))]
    rows = sorted(read_consumers(spark, paths, app_id=5).collect(), key=lambda r: r.consumer_id)
    assert [(r.app_id, r.consumer_id, r["group"]) for r in rows] == [(5, 71, None), (5, 72, "Wholesale")]


def test_endpoints_page(spark, workdir):
    page = {"data": [{"id": 41, "method": "DELETE", "path": "/carts/{cart}"},
                     {"id": 42, "method": "PATCH", "path": "/carts"}]}
    rows = read_endpoints(spark, _write(workdir, "e.json", json.dumps(page)), 3).collect()
    assert sorted((r.endpoint_id, r.method, r.path) for r in rows) == [
        (41, "DELETE", "/carts/{cart}"), (42, "PATCH", "/carts")]


def test_metrics_ndjson_subset(spark, workdir):
    lines = [{"period_start": "2025-01-01T00:00:00Z", "period_end": "2025-01-01T01:00:00Z",
              "method": "GET", "requests": 812, "error_rate": 0.125},
             {"period_start": "2025-01-01T01:00:00Z", "period_end": "2025-01-01T02:00:00Z",
              "method": "POST", "requests": 64, "error_rate": 0.25}]
    p = _write(workdir, "m.ndjson", "\n".join(json.dumps(x) for x in lines))
    df = read_metrics_ndjson(spark, p, app_id=1)
    rows = sorted(df.collect(), key=lambda r: r.requests)
    assert [(r.app_id, r.method, r.requests, r.error_rate, r.path) for r in rows] == [
        (1, "POST", 64, 0.25, None), (1, "GET", 812, 0.125, None)]
    assert len(df.columns) == 20


def test_request_logs_ndjson(spark, workdir):
    lines = [{"timestamp": "2025-01-01T00:00:00Z", "request_uuid": "abc", "method": "GET",
              "url": "https://x/1", "status_code": 200,
              "request_headers": [["Content-Type", "application/json"]]},
             {"timestamp": "2025-01-01T00:01:00Z", "request_uuid": "def", "method": "POST",
              "url": "https://x/2", "status_code": 201}]
    p = _write(workdir, "r.ndjson", "\n".join(json.dumps(x) for x in lines))
    rows = {r.request_uuid: r for r in read_request_logs_ndjson(spark, p, 1).collect()}
    assert rows["abc"].request_headers[0].name == "Content-Type"
    assert rows["def"].request_headers is None and rows["def"].status_code == 201


def _arrow_file(path, table):
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)


def test_metrics_arrow_stream(spark, workdir):
    t = pa.table({"period_start": pa.array([1772985600000], pa.timestamp("ms", "UTC")),
                  "period_end": pa.array([1772989200000], pa.timestamp("ms", "UTC")),
                  "method": pa.array(["GET"]), "requests": pa.array([42], pa.int64()),
                  "error_rate": pa.array([0.5])})
    p = os.path.join(workdir, "m.arrow")
    _arrow_file(p, t)
    r = read_arrow_streams(spark, [p]).collect()[0]
    assert (r.method, r.requests, r.error_rate) == ("GET", 42, 0.5)
    assert r.period_start.year == 2026


def test_request_logs_arrow_headers_renamed(spark, workdir):
    hdr = pa.list_(pa.struct([("1", pa.utf8()), ("2", pa.utf8())]))
    t = pa.table({"timestamp": pa.array([1772985600000], pa.timestamp("ms", "UTC")),
                  "request_uuid": ["abc"], "method": ["GET"], "url": ["https://x"],
                  "request_headers": pa.array([[{"1": "content-type", "2": "application/json"}]], hdr)})
    paths = []
    for i in range(2):
        paths.append(os.path.join(workdir, f"r{i}.arrow"))
        _arrow_file(paths[-1], t)
    df = read_arrow_streams(spark, paths)
    df = df.withColumn("request_headers", reshape_pairs(F.col("request_headers")))
    rows = df.collect()
    assert len(rows) == 2 and rows[0].request_headers[0].name == "content-type"


def test_request_details_three_tables(spark, workdir):
    doc = {"timestamp": "2026-03-08T17:42:00.000Z", "request_uuid": "r-1", "env": "prod",
           "method": "PUT", "path": "/carts/{cart}", "url": "https://shop.example/carts/8", "consumer_id": 72,
           "consumer": {"identifier": "ignored"},
           "request_headers": [["content-type", "application/json"]], "request_size_bytes": 0,
           "request_body_json": None, "status_code": 500, "response_time_ms": 37,
           "response_headers": [["x-shard", "s4"]], "response_size_bytes": 19,
           "response_body_json": "{\"fault\":7}", "client_ip": "198.51.100.23",
           "client_country_iso_code": "PT", "trace_id": "7" * 32,
           "exception": {"type": "CartLocked", "message": "cart 8 is locked", "stacktrace": "at cart.py:5",
                         "sentry_event_id": None},
           "logs": [{"timestamp": "2026-03-08T17:42:00.100Z", "message": "locking cart",
                     "level": "DEBUG", "logger": "carts", "file": "cart.py", "line": 5}],
           "spans": [{"span_id": "c0ffee", "parent_span_id": None, "name": "lock cart",
                      "kind": "SERVER", "start_time_ns": 1772991720000000000,
                      "end_time_ns": 1772991720050000000, "duration_ns": 50000000,
                      "status": "OK", "attributes": {"cart.id": 8}}]}
    p = _write(workdir, "d.json", json.dumps(doc))
    req, logs, spans = read_request_details(spark, p, app_id=7)
    r = req.collect()[0]
    assert (r.app_id, r.exception_type, r.request_headers[0].value) == (7, "CartLocked",
                                                                      "application/json")
    assert logs.collect()[0].line == 5
    s = spans.collect()[0]
    assert json.loads(s.attributes) == {"cart.id": 8} and s.parent_span_id is None


def test_request_details_round_trip(spark, workdir):
    """document -> three tables -> request-details document -> same content."""
    from trafficlens.operators.details import request_details, request_details_json
    doc = {"timestamp": "2026-03-08T17:42:00.000000Z", "request_uuid": "r-9", "env": "prod",
           "method": "GET", "path": "/t", "url": "https://api/t", "consumer_id": 1,
           "request_headers": [["content-type", "application/json"]], "request_size_bytes": 0,
           "request_body_json": None, "status_code": 200, "response_time_ms": 12,
           "response_headers": [], "response_size_bytes": 3, "response_body_json": "{}",
           "client_ip": None, "client_country_iso_code": "DE", "trace_id": "ab",
           "exception": None,
           "logs": [{"timestamp": "2026-03-08T17:42:00.100000Z", "message": "m", "level": "INFO",
                     "logger": "app", "file": "main.py", "line": 1}],
           "spans": [{"span_id": "s1", "parent_span_id": None, "name": "root", "kind": "SERVER",
                      "start_time_ns": 1, "end_time_ns": 3, "duration_ns": 2, "status": "OK",
                      "attributes": {"http.method": "GET", "n": 1}}]}
    req, logs, spans = read_request_details(spark, _write(workdir, "d2.json", json.dumps(doc)), 4)
    out = request_details_json(request_details(req, logs, spans, "r-9", 4)).collect()[0]
    got = json.loads(out.json)
    for k, v in doc.items():
        assert got[k] == v, k


def test_arrow_stream_lz4(spark, workdir):
    t = pa.table({"method": pa.array(["GET", "PUT"]), "requests": pa.array([1, 2], pa.int64())})
    p = os.path.join(workdir, "lz4.arrow")
    opts = pa.ipc.IpcWriteOptions(compression="lz4")
    with pa.OSFile(p, "wb") as sink, pa.ipc.new_stream(sink, t.schema, options=opts) as w:
        w.write_table(t)
    assert sorted(r.requests for r in read_arrow_streams(spark, [p]).collect()) == [1, 2]


@pytest.mark.parametrize("line", ['{"timestamp": "2026-03-08T17:4', '{"timestamp": "yesterday", "request_uuid": "b", "method": "GET", "url": "u"}',
                                  '{"timestamp": "2026-03-08T17:42:00Z", "method": "GET", "url": "u"}'])
def test_bad_rows_are_errors(spark, workdir, line):
    good = '{"timestamp": "2026-03-08T17:42:00Z", "request_uuid": "a", "method": "GET", "url": "u"}'
    p = _write(workdir, "bad.ndjson", good + "\n" + line)
    with pytest.raises(Exception):
        read_request_logs_ndjson(spark, p, 1).collect()
    assert read_request_logs_ndjson(spark, _write(workdir, "good.ndjson", good), 1).count() == 1


def test_bad_pages_are_errors(spark, workdir):
    with pytest.raises(Exception):
        read_endpoints(spark, _write(workdir, "e1.json", '{"data": [{"method": "GET", "path": "/x"}]}'), 1).collect()
    with pytest.raises(Exception):
        read_endpoints(spark, _write(workdir, "e2.json", "<html>busy</html>"), 1).collect()


def test_arrow_files_of_different_columns(spark, workdir):
    paths = [os.path.join(workdir, f"u{i}.arrow") for i in range(2)]
    _arrow_file(paths[0], pa.table({"method": ["GET"], "requests": pa.array([1], pa.int32())}))
    _arrow_file(paths[1], pa.table({"method": ["PUT"], "requests": pa.array([2**40], pa.int64()), "path": ["/late"]}))
    got = sorted((r.method, r.requests, r.path) for r in read_arrow_streams(spark, paths).collect())
    assert got == [("GET", 1, None), ("PUT", 2**40, "/late")]


def test_arrow_to_store(spark, workdir):
    from trafficlens.sources.tables import TableStore
    from trafficlens.streaming.landing import land_arrow_metrics, land_arrow_request_logs
    store = TableStore(spark, os.path.join(workdir, "store"))
    hdr = pa.list_(pa.struct([("1", pa.utf8()), ("2", pa.utf8())]))

    def logs(name, status):
        p = os.path.join(workdir, name)
        _arrow_file(p, pa.table({"timestamp": pa.array([1772985600000], pa.timestamp("ms", "UTC")), "request_uuid": ["a"], "method": ["GET"], "url": ["u"],
                                 "status_code": pa.array([status], pa.int32()), "request_headers": pa.array([[{"1": "x-shard", "2": "s4"}]], hdr)}))
        return [p]

    land_arrow_request_logs(spark, logs("l1.arrow", 500), store, 6)
    land_arrow_request_logs(spark, logs("l2.arrow", 200), store, 6)
    r = store.read("request_logs", app_id=6).collect()
    assert [(x.status_code, x.request_headers[0].name) for x in r] == [(200, "x-shard")]
    p = os.path.join(workdir, "m2.arrow")
    _arrow_file(p, pa.table({"period_start": pa.array([1772985600000], pa.timestamp("ms", "UTC")), "period_end": pa.array([1772989200000], pa.timestamp("ms", "UTC")), "requests": pa.array([5], pa.int64())}))
    for _ in range(2):
        land_arrow_metrics(spark, [p], store, 6)
    assert [x.requests for x in store.read("metrics", app_id=6).collect()] == [5]


def test_pages_to_store(spark, workdir):
    from trafficlens.sources.tables import TableStore
    from trafficlens.streaming.landing import land_pages
    store = TableStore(spark, os.path.join(workdir, "pstore"))
    for path in ("/carts", "/baskets"):
        page = {"data": [{"id": 42, "method": "PATCH", "path": path}]}
        land_pages(spark, store, 31, endpoints=_write(workdir, "e.json", json.dumps(page)))
    assert [(r.endpoint_id, r.path) for r in store.read("endpoints", app_id=31).collect()] == [(42, "/baskets")]


def test_consumers_fetch_without_its_last_page(spark, workdir):
    import pytest

    def fetch(name, *pages):
        folder = os.path.join(workdir, name)
        os.makedirs(folder)
        for i, page in enumerate(pages):
            item = {"id": i + 1, "identifier": f"c{i}", "created_at": "2025-01-01T00:00:00Z"}
            with open(os.path.join(folder, f"p{i}.json"), "w") as f:
                json.dump({"data": [item], **page}, f)
        return folder

    first, second, last = {"has_more": True, "next_token": "t1"}, {"has_more": True, "next_token": "t2"}, {"has_more": False}
    whole = [fetch("whole", first, second, last), fetch("single", last)]
    assert read_consumers(spark, whole, 3).count() == 4
    for broken in (fetch("cut", first, second), fetch("two-ends", first, last, last), fetch("same", first, first, last), fetch("no-token", {"has_more": True}, last)):
        with pytest.raises(Exception, match="a fetch with|a next page of its own"):
            read_consumers(spark, [*whole, broken], 3).collect()
