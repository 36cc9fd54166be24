import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["app_id", "method", "path", "status_code", "requests_sum"]
    assert [r.requests_sum for r in rows] == sorted((r.requests_sum for r in rows), reverse=True)


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_queries_run_small(spark):
    qs = E.queries()
    for name in ["q_metrics_tz_hour", "q_span_tree", "q_json_items", "q_upsert_request_logs",
                 "q_request_details", "q_logs_sample_size"]:
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0, name


def test_documented_orders(spark):
    qs = E.queries()
    rows = qs["q_logs_sorted"](spark, "/root/testdata/sf0.001").collect()
    assert rows == sorted(rows, key=lambda r: (r.timestamp, r.request_uuid)) and len(rows) > 1
    rows = qs["q_endpoints_sorted"](spark, "/root/testdata/sf0.001").collect()
    assert [(r.path, r.method) for r in rows] == sorted((r.path, r.method) for r in rows)


def test_building_a_query_starts_no_job(spark):
    """Plans are left to Spark: only the checkpointed walk of the span tree runs while it is built."""
    tracker = spark.sparkContext.statusTracker()
    for name, build in E.queries().items():
        if name.startswith("q_") and not name.startswith("q_span_tree"):
            build(spark, "/root/testdata/sf0.001")  # reads the tables' schemas, once per session
            spark.sparkContext.setJobGroup(f"build-{name}", name)
            build(spark, "/root/testdata/sf0.001")
            assert not tracker.getJobIdsForGroup(f"build-{name}"), name
    spark.sparkContext.setJobGroup("done", "done")
