"""Plan properties that the scale design relies on, checked on the physical plans."""

import re

import __spark_entry__ as E
from trafficlens.operators.logs import request_logs
from trafficlens.operators.metrics import metrics
from trafficlens.operators.store import upsert
from conftest import opened
from trafficlens.sources.tables import TableStore
from trafficlens.sources.testtables import register_views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_uses_a_cross_join(spark):
    bad = {}
    for name, fn in E.queries().items():
        p = plan(fn(spark, SF))
        if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p):
            bad[name] = p[:200]
    assert not bad


def test_metrics_without_percentiles_is_one_shuffle(spark):
    rl = register_views(spark, SF)["request_logs"]
    p = plan(metrics(rl, ["requests", "error_rate", "bytes_sent"], interval="hour",
                     group_by=["method", "path"]))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "partial_count" in p


def test_small_upsert_broadcasts_staged_keys(spark):
    rl = register_views(spark, SF)["request_logs"]
    staged = rl.filter("timestamp >= '2024-01-29'")
    p = plan(upsert(rl, staged, table="request_logs"))
    assert re.search(r"BroadcastHashJoin .*LeftAnti", p)


def test_scoped_store_read_prunes_and_pushes(spark, workdir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")  # untruncated filter lists
    st = TableStore(spark, workdir + "/plans")
    st.write("request_logs", register_views(spark, SF)["request_logs"])
    scoped = st.read("request_logs", app_id=2, since="2024-01-10", until="2024-01-12")
    assert all("app_id=2/_date=2024-01-1" in f for f in opened(scoped))
    df = request_logs(scoped, app_id=2, since="2024-01-10",
                      until="2024-01-12", fields=["status_code"],
                      filters=[{"field": "status_code", "op": "gte", "value": 400}])
    p = plan(df)
    assert "GreaterThanOrEqual(timestamp" in p and "GreaterThanOrEqual(status_code,400)" in p
    read_schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "response_body_json" not in read_schema and "request_headers" not in read_schema
