import json
import os

from trafficlens.sources.tables import TableStore
from trafficlens.streaming.landing import land_request_logs


def _land(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


def test_two_landings_one_row_per_key_newest_value(spark, workdir):
    landing = os.path.join(workdir, "landing")
    os.makedirs(landing)
    store = TableStore(spark, os.path.join(workdir, "store"))
    ckpt = os.path.join(workdir, "ckpt")
    base = {"timestamp": "2025-01-01T00:00:00Z", "method": "GET", "url": "https://x"}
    _land(landing, "a.json", [dict(base, request_uuid="r1", status_code=200),
                              dict(base, request_uuid="r2", status_code=200)])
    land_request_logs(spark, landing, store, app_id=1, checkpoint=ckpt).awaitTermination()
    _land(landing, "b.json", [dict(base, request_uuid="r2", status_code=500),
                              dict(base, request_uuid="r3", status_code=201)])
    land_request_logs(spark, landing, store, app_id=1, checkpoint=ckpt).awaitTermination()
    rows = {r.request_uuid: r.status_code for r in store.read("request_logs").collect()}
    assert rows == {"r1": 200, "r2": 500, "r3": 201}
    # re-running with nothing new changes nothing
    land_request_logs(spark, landing, store, app_id=1, checkpoint=ckpt).awaitTermination()
    assert store.read("request_logs").count() == 3


def test_metrics_landing_range_replace(spark, workdir):
    from trafficlens.streaming.landing import land_metrics
    landing = os.path.join(workdir, "m")
    os.makedirs(landing)
    store = TableStore(spark, os.path.join(workdir, "mstore"))
    ckpt = os.path.join(workdir, "mckpt")
    hour = lambda h, n: {"period_start": f"2025-01-01T{h:02d}:00:00Z",
                         "period_end": f"2025-01-01T{h + 1:02d}:00:00Z", "requests": n}
    _land(landing, "a.json", [hour(0, 1), hour(1, 2), hour(2, 3)])
    land_metrics(spark, landing, store, app_id=3, checkpoint=ckpt).awaitTermination()
    _land(landing, "b.json", [hour(1, 20), hour(2, 30)])
    land_metrics(spark, landing, store, app_id=3, checkpoint=ckpt).awaitTermination()
    rows = sorted((r.period_start.hour, r.requests) for r in store.read("metrics").collect())
    assert rows == [(0, 1), (1, 20), (2, 30)]


def test_request_details_landing(spark, workdir):
    from trafficlens.streaming.landing import land_request_details
    landing = os.path.join(workdir, "d")
    os.makedirs(landing)
    store = TableStore(spark, os.path.join(workdir, "dstore"))
    ckpt = os.path.join(workdir, "dckpt")

    def doc(uuid, n_logs, status):
        return {"timestamp": "2025-01-01T00:00:00Z", "request_uuid": uuid, "method": "GET",
                "url": "https://x", "status_code": status, "request_headers": [],
                "response_headers": [],
                "logs": [{"timestamp": "2025-01-01T00:00:01Z", "message": f"m{i}"}
                         for i in range(n_logs)],
                "spans": [{"span_id": "s", "name": "root", "kind": "SERVER", "start_time_ns": 1,
                           "end_time_ns": 2, "duration_ns": 1, "status": "OK",
                           "attributes": {"a": 1}}]}
    with open(os.path.join(landing, "a.json"), "w") as f:
        json.dump(doc("r1", 2, 200), f)
    land_request_details(spark, landing, store, app_id=1, checkpoint=ckpt).awaitTermination()
    with open(os.path.join(landing, "b.json"), "w") as f:
        json.dump(doc("r1", 0, 500), f)
    land_request_details(spark, landing, store, app_id=1, checkpoint=ckpt).awaitTermination()
    assert [r.status_code for r in store.read("request_logs").collect()] == [500]
    assert store.read("application_logs").count() == 0
    assert store.read("spans").count() == 1


def test_newest_fetch_wins_within_one_batch(spark, workdir):
    landing = os.path.join(workdir, "n")
    os.makedirs(landing)
    store = TableStore(spark, os.path.join(workdir, "nstore"))
    base = {"timestamp": "2025-01-01T00:00:00Z", "method": "GET", "url": "https://x", "request_uuid": "r1"}
    _land(landing, "z-older.json", [dict(base, status_code=500)])
    _land(landing, "a-newer.json", [dict(base, status_code=200)])
    os.utime(os.path.join(landing, "z-older.json"), (1_700_000_000, 1_700_000_000))
    land_request_logs(spark, landing, store, app_id=1, checkpoint=os.path.join(workdir, "nc")).awaitTermination()
    assert [r.status_code for r in store.read("request_logs").collect()] == [200]


def test_metrics_fetches_of_one_batch(spark, workdir):
    from trafficlens.streaming.landing import land_metrics
    landing, ckpt = os.path.join(workdir, "f"), os.path.join(workdir, "fc")
    os.makedirs(landing)
    store = TableStore(spark, os.path.join(workdir, "fstore"))
    day = lambda d, n: {"period_start": f"2025-01-{d:02d}T00:00:00Z",
                        "period_end": f"2025-01-{d + 1:02d}T00:00:00Z", "requests": n}
    _land(landing, "base.json", [day(5, 1)])
    land_metrics(spark, landing, store, app_id=3, checkpoint=ckpt).awaitTermination()
    _land(landing, "one.json", [day(1, 2)])
    _land(landing, "ten.json", [day(10, 3)])
    _land(landing, "ten-again.json", [day(10, 3)])
    land_metrics(spark, landing, store, app_id=3, checkpoint=ckpt).awaitTermination()
    rows = sorted((r.period_start.day, r.requests) for r in store.read("metrics").collect())
    assert rows == [(1, 2), (5, 1), (10, 3)]


def test_document_twice_in_one_batch(spark, workdir):
    from trafficlens.streaming.landing import land_request_details
    landing = os.path.join(workdir, "dd")
    os.makedirs(landing)
    store = TableStore(spark, os.path.join(workdir, "ddstore"))
    doc = {"timestamp": "2025-01-01T00:00:00Z", "request_uuid": "r1", "method": "GET", "url": "https://x",
           "logs": [{"timestamp": "2025-01-01T00:00:01Z", "message": "m"}], "spans": []}
    for name in ("a.json", "b.json"):
        with open(os.path.join(landing, name), "w") as f:
            json.dump(doc, f)
    land_request_details(spark, landing, store, app_id=1, checkpoint=os.path.join(workdir, "ddc")).awaitTermination()
    assert store.read("request_logs").count() == 1 and store.read("application_logs").count() == 1


def test_malformed_input_stops_the_stream(spark, workdir):
    import pytest
    landing = os.path.join(workdir, "bad")
    os.makedirs(landing)
    store = TableStore(spark, os.path.join(workdir, "bstore"))
    with open(os.path.join(landing, "a.json"), "w") as f:
        f.write('{"timestamp": "2025-01-01T00:00:00Z", "request_uuid": "r1", "method": "GET", "url": "u"}\n{"timest')
    with pytest.raises(Exception):
        land_request_logs(spark, landing, store, app_id=1, checkpoint=os.path.join(workdir, "bc")).awaitTermination()
    assert store.read("request_logs").count() == 0


def test_replayed_epoch_gives_equal_tables(spark, workdir):
    """Spark runs an epoch again when its commit was not recorded."""
    landing, ckpt = os.path.join(workdir, "re"), os.path.join(workdir, "rec")
    os.makedirs(landing)
    store = TableStore(spark, os.path.join(workdir, "restore"))
    base = {"method": "GET", "url": "https://x"}
    for i, name in enumerate(("a.json", "b.json")):
        _land(landing, name, [dict(base, request_uuid=f"r{k}", status_code=200 + i, timestamp=f"2025-01-0{1 + k}T00:00:00Z") for k in range(i, i + 3)])
        land_request_logs(spark, landing, store, app_id=1, checkpoint=ckpt).awaitTermination()
    want = sorted(map(str, store.read("request_logs").collect()))
    os.replace(os.path.join(ckpt, "commits", "1"), os.path.join(workdir, "commit-1"))
    crc = os.path.join(ckpt, "commits", ".1.crc")
    if os.path.exists(crc):
        os.replace(crc, os.path.join(workdir, "commit-1.crc"))
    land_request_logs(spark, landing, store, app_id=1, checkpoint=ckpt).awaitTermination()
    assert os.path.exists(os.path.join(ckpt, "commits", "1"))
    assert sorted(map(str, store.read("request_logs").collect())) == want and len(want) == 4
