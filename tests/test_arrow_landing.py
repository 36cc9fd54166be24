import os
import time
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest

from trafficlens.sources.arrow_stream import register_arrow
from trafficlens.sources.tables import TableStore
from trafficlens.streaming.landing import land_metrics, land_request_logs

T0 = datetime(2025, 3, 1, tzinfo=timezone.utc)
PAIRS = pa.list_(pa.struct([("1", pa.string()), ("2", pa.string())]))


def _write(path, table, at=None):
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table, max_chunksize=2)
    if at is not None:
        os.utime(path, (at, at))


def _logs(keys, status, **extra):
    n = len(keys)
    return pa.table({"timestamp": pa.array([T0 + timedelta(days=k) for k in keys], pa.timestamp("ms", tz="UTC")),
                     "request_uuid": [f"r{k}" for k in keys], "method": ["PUT"] * n, "url": ["https://shop.test/"] * n,
                     "status_code": pa.array([status] * n, pa.int32()),
                     "request_headers": pa.array([[{"1": "Accept", "2": "a/b"}]] * n, PAIRS), **extra})


def _folder(workdir, name):
    path = os.path.join(workdir, name)
    os.makedirs(path)
    return path


def test_request_logs_land_from_arrow_and_a_replay_changes_nothing(spark, workdir):
    landing, ckpt = _folder(workdir, "in put"), os.path.join(workdir, "ckpt")
    store = TableStore(spark, os.path.join(workdir, "store"))

    def land():
        land_request_logs(spark, landing, store, app_id=4, checkpoint=ckpt, arrow=True).awaitTermination()

    _write(os.path.join(landing, "one 100%.arrow"), _logs([1, 2, 3], 200))
    land()
    # a file an hour older than those seen still lands; it has a column the first lacks
    _write(os.path.join(landing, "two.arrow"), _logs([3, 4], 503, client_ip=["::1", "::2"]), at=time.time() - 3600)
    land()

    def rows():
        return sorted((r.request_uuid, r.status_code, r.client_ip, r.request_headers[0]["name"], r.app_id) for r in store.read("request_logs").collect())

    want = [("r1", 200, None, "Accept", 4), ("r2", 200, None, "Accept", 4), ("r3", 503, "::1", "Accept", 4), ("r4", 503, "::2", "Accept", 4)]
    assert rows() == want
    os.replace(os.path.join(ckpt, "commits", "1"), os.path.join(workdir, "commit"))
    crc = os.path.join(ckpt, "commits", ".1.crc")
    if os.path.exists(crc):
        os.replace(crc, os.path.join(workdir, "commit.crc"))
    land()
    assert os.path.exists(os.path.join(ckpt, "commits", "1")) and rows() == want


def test_newest_arrow_file_and_its_last_row_win_within_one_batch(spark, workdir):
    landing = _folder(workdir, "n")
    store = TableStore(spark, os.path.join(workdir, "store"))
    _write(os.path.join(landing, "a.arrow"), pa.concat_tables([_logs([1, 2], 201), _logs([1], 202)]), at=1_700_000_100)
    _write(os.path.join(landing, "b.arrow"), _logs([1, 2], 500), at=1_700_000_000)
    land_request_logs(spark, landing, store, app_id=1, checkpoint=os.path.join(workdir, "c"), arrow=True).awaitTermination()
    assert sorted((r.request_uuid, r.status_code) for r in store.read("request_logs").collect()) == [("r1", 202), ("r2", 201)]


def test_metrics_land_from_arrow_fetch_by_fetch(spark, workdir):
    landing, ckpt = _folder(workdir, "m"), os.path.join(workdir, "c")
    store = TableStore(spark, os.path.join(workdir, "store"))

    def fetch(name, days, requests):
        at = [T0 + timedelta(days=d) for d in days]
        _write(os.path.join(landing, name), pa.table({"period_start": pa.array(at, pa.timestamp("ms", tz="UTC")),
               "period_end": pa.array([x + timedelta(days=1) for x in at], pa.timestamp("ms", tz="UTC")), "requests": [requests] * len(days)}))

    fetch("base.arrow", [0, 1, 2, 9], 1)
    land_metrics(spark, landing, store, app_id=2, checkpoint=ckpt, arrow=True).awaitTermination()
    fetch("x.arrow", [1, 2], 5)
    fetch("y.arrow", [9], 7)
    land_metrics(spark, landing, store, app_id=2, checkpoint=ckpt, arrow=True).awaitTermination()
    assert sorted((r.period_start.day, r.requests) for r in store.read("metrics").collect()) == [(1, 1), (2, 5), (3, 5), (10, 7)]


def test_damaged_stream_stops_the_landing(spark, workdir):
    landing = _folder(workdir, "d")
    store = TableStore(spark, os.path.join(workdir, "store"))
    whole = os.path.join(workdir, "whole.arrow")
    _write(whole, _logs([1, 2, 3, 4, 5], 200))
    with open(whole, "rb") as f, open(os.path.join(landing, "cut.arrow"), "wb") as g:
        g.write(f.read()[:-400])
    with pytest.raises(Exception):
        land_request_logs(spark, landing, store, app_id=1, checkpoint=os.path.join(workdir, "c"), arrow=True).awaitTermination()
    assert store.read("request_logs").count() == 0


def test_arrow_data_source(spark, workdir):
    register_arrow(spark)
    top = _folder(workdir, "s")
    os.makedirs(os.path.join(top, "day=1"))
    _write(os.path.join(top, "a.arrow"), _logs([1, 2, 3], 200))
    _write(os.path.join(top, "day=1", "b.arrow"), _logs([4], 404, client_ip=["::1"]))
    with open(os.path.join(top, "_SUCCESS"), "w"):
        pass
    df = spark.read.format("arrow_streams").load(top)
    assert df.rdd.getNumPartitions() == 2  # a file each
    got = sorted((r.request_uuid, r.status_code, r.client_ip) for r in df.select("request_uuid", "status_code", "client_ip").collect())
    assert got == [("r1", 200, None), ("r2", 200, None), ("r3", 200, None), ("r4", 404, "::1")]
    assert df.agg({"timestamp": "min"}).first()[0] == datetime(2025, 3, 2)
    one = spark.read.format("arrow_streams").schema("status_code long").load([os.path.join(top, "a.arrow")])
    assert [r.status_code for r in one.collect()] == [200] * 3
    with pytest.raises(Exception, match="no Arrow streams"):
        spark.read.format("arrow_streams").load(_folder(workdir, "none")).count()
