from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import opened
from trafficlens.operators.store import (align, dedup, range_replace, range_replace_fetches, replace_children,
                                         spread, upsert)
from trafficlens.schemas import TABLES
from trafficlens.sources.tables import TableStore


def _m(spark, rows):
    d = [(a, datetime(2025, 1, s), datetime(2025, 1, e)) for a, s, e in rows]
    return spark.createDataFrame(d, "app_id int, period_start timestamp, period_end timestamp")


def _triples(df):
    return sorted((r.app_id, r.period_start.day, r.period_end.day) for r in df.collect())


def test_range_replace_containment(spark):
    base = _m(spark, [(1, 1, 2), (1, 2, 3), (1, 3, 5), (2, 2, 3)])
    staged = _m(spark, [(1, 2, 3), (1, 3, 4)])
    out = range_replace(base, staged)
    # only (1,2,3) of the base lies inside [2, 4]; (1,3,5) straddles and survives;
    # app 2 is untouched
    assert _triples(out) == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 3, 5), (2, 2, 3)]


def test_range_replace_empty_staged_deletes_nothing(spark):
    base = _m(spark, [(1, 1, 2), (1, 2, 3)])
    staged = spark.createDataFrame([], base.schema)
    assert _triples(range_replace(base, staged)) == [(1, 1, 2), (1, 2, 3)]


def _logs(spark, rows):
    return align(spark.createDataFrame(rows, "app_id int, timestamp timestamp, request_uuid string, "
                                             "method string, url string, response_body_json string"),
                 "request_logs")


def test_upsert_whole_row_null_overwrite(spark):
    t = datetime(2025, 1, 1)
    base = _logs(spark, [(1, t, "a", "GET", "u", '{"x":1}'), (1, t, "b", "GET", "u", '{"y":2}')])
    staged = spark.createDataFrame([(1, t, "a", "POST", "u")],
                                   "app_id int, timestamp timestamp, request_uuid string, method string, url string")
    out = {r.request_uuid: r for r in upsert(base, staged, table="request_logs").collect()}
    assert out["a"].method == "POST" and out["a"].response_body_json is None
    assert out["b"].response_body_json == '{"y":2}'
    assert len(out) == 2


def test_upsert_dedupes_staged(spark):
    t = datetime(2025, 1, 1)
    base = _logs(spark, [])
    staged = _logs(spark, [(1, t, "a", "GET", "u", None), (1, t, "a", "PUT", "u", None)])
    out = upsert(base, staged, table="request_logs").collect()
    assert len(out) == 1 and out[0].method == "PUT"  # the greatest row wins
    numbered = staged.withColumn("seq", F.when(F.col("method") == "GET", 2).otherwise(1))
    out = upsert(base, numbered, table="request_logs", newest=("seq",)).collect()
    assert [r.method for r in out] == ["GET"] and "seq" not in out[0]


def test_replace_children(spark):
    t = datetime(2025, 1, 1)
    base = spark.createDataFrame([(1, "r1", t, "m1"), (1, "r1", t, "m2"), (1, "r2", t, "m3")],
                                 "app_id int, request_uuid string, timestamp timestamp, message string")
    parents = spark.createDataFrame([(1, "r1")], "app_id int, request_uuid string")
    staged = spark.createDataFrame([], base.schema)
    out = replace_children(base, staged, parents).collect()
    assert [(r.request_uuid, r.message) for r in out] == [("r2", "m3")]


def test_write_by_app_and_reset(spark, workdir):
    st = TableStore(spark, workdir + "/store")
    apps = spark.createDataFrame([(1, "A", "FastAPI", "c", datetime(2025, 1, 1)),
                                  (2, "B", "Express", "d", datetime(2025, 1, 1))], TABLES["apps"])
    st.write("apps", apps)
    st.write("my_table", spark.range(3).withColumn("app_id", F.lit(1)))
    assert st.read("apps").count() == 2 and st.read("my_table").count() == 3
    # a one-app refetch replaces that app only
    upd = upsert(st.read("apps", app_id=2),
                 spark.createDataFrame([(2, "B2", "Express", "d", datetime(2025, 1, 2))],
                                       TABLES["apps"]), table="apps")
    st.write("apps", upd, apps=[2])
    assert sorted(r.name for r in st.read("apps").collect()) == ["A", "B2"]
    # an app whose new content is empty has no rows left
    st.write("apps", st.read("apps", app_id=1).limit(0), apps=[1])
    assert [r.app_id for r in st.read("apps").collect()] == [2]
    assert st.tables() == ["apps", "my_table"]
    st.reset()
    assert st.tables() == []
    assert all(st.read(t).count() == 0 for t in TABLES)


def test_align_stamps_app_and_fills(spark):
    df = spark.createDataFrame([("x",)], "method string")
    r = align(df, "endpoints", app_id=9).collect()[0]
    assert r.app_id == 9 and r.method == "x" and r.path is None
    assert align(df, "endpoints").columns == ["app_id", "endpoint_id", "method", "path"]


def test_additive_schema_evolution(spark, workdir):
    """A metrics version written before p90/p99 existed reads with those columns NULL."""
    st = TableStore(spark, workdir + "/evo")
    old = spark.createDataFrame([(1, datetime(2025, 1, 1), datetime(2025, 1, 2), 10, 5)],
                                "app_id int, period_start timestamp, period_end timestamp, "
                                "requests bigint, response_time_p50 int")
    st.write("metrics", old)
    r = st.read("metrics").collect()[0]
    assert r.requests == 10 and r.response_time_p50 == 5 and r.response_time_p99 is None
    assert len(st.read("metrics").columns) == len(TABLES["metrics"].fields)


def test_store_time_scoped_read_pushes_down(spark, workdir):
    from trafficlens.sources.testtables import register_views
    st = TableStore(spark, workdir + "/scoped")
    rl = register_views(spark, "/root/testdata/sf0.001")["request_logs"]
    st.write("request_logs", rl)
    df = st.read("request_logs", app_id=2, since="2024-01-10", until="2024-01-12")
    dates = {p.rpartition("_date=")[2].split("/")[0] for p in opened(df)}
    assert dates == {"2024-01-10", "2024-01-11"} and all("app_id=2/" in p for p in opened(df))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(timestamp" in plan
    exp = rl.filter("app_id = 2 AND timestamp >= '2024-01-10' AND timestamp < '2024-01-12'").count()
    assert df.count() == exp > 0


def _files(st, table):
    return set(st._stored(table).inputFiles())


def test_merge_rewrites_touched_dates_only(spark, workdir):
    st = TableStore(spark, workdir + "/dates")
    rows = [(1, datetime(2025, 1, d), f"r{d}", "GET", "u", None) for d in range(1, 8)]
    st.write("request_logs", _logs(spark, rows))
    before = _files(st, "request_logs")
    # r3 moves from the 3rd to the 9th; r5 is replaced where it is
    staged = _logs(spark, [(1, datetime(2025, 1, 9), "r3", "PUT", "u", None), (1, datetime(2025, 1, 5), "r5", "PUT", "u", None)])
    st.merge("request_logs", 1, staged, ["app_id", "request_uuid"], lambda c, s: upsert(c, s, table="request_logs"))
    kept = {f.rpartition("_date=")[2].split("/")[0] for f in _files(st, "request_logs") & before}
    assert kept == {f"2025-01-0{d}" for d in (1, 2, 4, 6, 7)}
    got = sorted((r.request_uuid, r.timestamp.day, r.method) for r in st.read("request_logs").collect())
    assert got == sorted([(f"r{d}", d, "GET") for d in (1, 2, 4, 6, 7)] + [("r3", 9, "PUT"), ("r5", 5, "PUT")])


def test_small_merge_opens_its_key_buckets_and_dates(spark, workdir):
    st = TableStore(spark, workdir + "/keys", buckets=64)
    st.write("request_logs", _logs(spark, [(1, datetime(2025, 1, 1 + i % 20), f"r{i}", "GET", "u", None) for i in range(400)]))
    staged = _logs(spark, [(1, datetime(2025, 1, 21), f"r{i}", "PUT", "u", None) for i in (0, 20, 40)])
    keys = staged.select(F.col("request_uuid").alias("key"))
    buckets = {f.rpartition("bucket=")[2].split("/")[0] for f in opened(st._known("request_logs", F.col("app_id") == 1, keys))}
    assert 1 <= len(buckets) <= 3
    assert [r.d for r in st._dates_of("request_logs", 1, staged).collect()] == ["2025-01-01"]
    before = _files(st, "request_logs")
    seen = []

    def fn(current, new):
        seen.extend(opened(current))
        return upsert(current, new, table="request_logs")

    st.merge("request_logs", 1, staged, ["app_id", "request_uuid"], fn)
    assert {f.rpartition("_date=")[2].split("/")[0] for f in seen} == {"2025-01-01"}
    assert {f.rpartition("_date=")[2].split("/")[0] for f in before - _files(st, "request_logs")} == {"2025-01-01"}
    assert st.read("request_logs").count() == 400
    st.compact_keys("request_logs", 1)
    assert {r.d for r in st._dates_of("request_logs", 1, staged).collect()} == {"2025-01-01", "2025-01-21"}


def test_failed_overwrite_is_finished_by_the_same_batch(spark, workdir, monkeypatch):
    st = TableStore(spark, workdir + "/crash")
    st.write("request_logs", _logs(spark, [(1, datetime(2025, 1, d), f"r{d}", "GET", "u", None) for d in (1, 2)]))
    staged = _logs(spark, [(1, datetime(2025, 1, 1), "r1", "PUT", "u", None), (1, datetime(2025, 1, 3), "r2", "PUT", "u", None)])
    args = ("request_logs", 1, staged, ["app_id", "request_uuid"], lambda c, s: upsert(c, s, table="request_logs"))

    def lost(table, batch):
        st._delete(f"{table}/app_id=1/_date=2025-01-01")  # the writer had removed a partition when it died
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(st, "_apply", lost)
        with pytest.raises(OSError):
            st.merge(*args, batch="b-0")
    st.merge(*args, batch="b-0")
    got = sorted((r.request_uuid, r.timestamp.day, r.method) for r in st.read("request_logs").collect())
    assert got == [("r1", 1, "PUT"), ("r2", 3, "PUT")]
    st.merge(*args, batch="b-0")  # nothing pending: computed again, with the same outcome
    assert sorted((r.request_uuid, r.timestamp.day, r.method) for r in st.read("request_logs").collect()) == got


def test_rows_of_other_dates_are_refused(spark, workdir):
    st = TableStore(spark, workdir + "/other")
    with pytest.raises(ValueError):
        st.replace("request_logs", 1, lambda c: _logs(spark, [(1, datetime(2025, 1, 9), "r", "GET", "u", None)]), dates=("2025-01-01", "2025-01-02"))
    assert st.read("request_logs").count() == 0


def test_spans_read_by_time(spark, workdir):
    st = TableStore(spark, workdir + "/spans")
    day = 86_400 * 10**9
    rows = [(1, "r", f"s{i}", None, "n", "SERVER", i * day + 5, i * day + 6, 1, "OK", None) for i in range(4)]
    st.write("spans", spark.createDataFrame(rows, TABLES["spans"]))
    df = st.read("spans", app_id=1, since="1970-01-02", until="1970-01-03")
    assert [r.span_id for r in st.scoped("spans", 1, "1970-01-03").collect()] in (["s2", "s3"], ["s3", "s2"])
    for bad in ((None, "1970-01-01"), (1, None)):
        with pytest.raises(ValueError):
            st.scoped("spans", *bad)
    assert [r.span_id for r in df.collect()] == ["s1"] and len({p.rpartition("/")[0] for p in opened(df)}) <= 2


def test_range_replace_of_several_fetches(spark):
    base = _m(spark, [(1, 5, 6), (1, 1, 2)])
    staged = spark.createDataFrame([(1, datetime(2025, 1, s), datetime(2025, 1, e), f, m) for s, e, f, m in
                                    [(1, 2, "a", 1), (10, 11, "b", 2), (10, 11, "c", 3)]],
                                   "app_id int, period_start timestamp, period_end timestamp, file string, at int")
    # day 5 is covered by no fetch; the later fetch of day 10 replaces the earlier one
    assert _triples(range_replace_fetches(base, staged, "file", ("at",))) == [(1, 1, 2), (1, 5, 6), (1, 10, 11)]


def test_free_sql_must_be_scoped(spark, workdir):
    from trafficlens.sources.sql import Unscoped

    st = TableStore(spark, workdir + "/guard")
    st.write("request_logs", _logs(spark, [(a, datetime(2025, 1, d), f"r{a}{d}", "GET", "u", None) for a in (1, 2) for d in (1, 2, 3)]))
    st.write("apps", spark.createDataFrame([(1, "A", "FastAPI", "c", datetime(2025, 1, 1))], TABLES["apps"]))
    scope = "app_id = 1 AND timestamp >= TIMESTAMP '2025-01-02'"
    assert st.sql(f"SELECT count(*) AS n FROM request_logs WHERE {scope}").first().n == 2
    assert st.sql("SELECT count(*) AS n FROM apps").first().n == 1
    joined = f"SELECT a.name, r.request_uuid FROM (SELECT * FROM request_logs WHERE {scope}) r JOIN apps a ON a.app_id = r.app_id"
    assert st.sql(joined).count() == 2
    for text in ("SELECT * FROM request_logs", "SELECT * FROM request_logs WHERE app_id = 1", "SELECT * FROM request_logs WHERE app_id IS NOT NULL AND timestamp IS NOT NULL",
                 "SELECT * FROM request_logs WHERE timestamp >= TIMESTAMP '2025-01-02'", f"SELECT * FROM request_logs WHERE {scope} OR method = 'PUT'",
                 "SELECT * FROM apps WHERE app_id IN (SELECT app_id FROM request_logs)", "SELECT (SELECT max(timestamp) FROM request_logs) AS t FROM apps",
                 f"SELECT * FROM request_logs WHERE {scope} UNION ALL SELECT * FROM request_logs"):
        with pytest.raises(Unscoped):
            st.sql(text)
            raise AssertionError(text)
    plan = st.sql(f"SELECT * FROM request_logs WHERE {scope}")
    assert all("app_id=1/" in f for f in opened(plan))


def _unspread(node, shuffled=True):
    """Partial whole-row aggregates that sort their rows in the stage that reads the input."""
    if "Exchange" in node.nodeName():
        shuffled = True
    kids = [node.children().apply(i) for i in range(node.children().size())]
    if node.nodeName() == "SortAggregate":
        shuffled = False
    return sum((_unspread(k, shuffled) for k in kids), []) if kids else [] if shuffled else [node.toString()]


def test_upsert_sorts_no_whole_rows_in_the_stage_that_reads_them(spark):
    t = datetime(2025, 1, 1)
    base = _logs(spark, [(1, t, "a", "GET", "u", None)])
    staged = base.withColumn("fetch", F.explode(F.array(F.lit(1), F.lit(2))))
    out = upsert(base, staged, table="request_logs", newest=("fetch",))
    assert _unspread(out._jdf.queryExecution().sparkPlan()) == []


def test_upsert_task_holds_a_part_of_what_a_split_unfolds_to(spark):
    """Each of two input splits unfolds to 3200 rows of 4 KB. By keys of their own the tasks after
    ``spread`` get a fraction of them; one key on all rows is read by a task for each split."""
    wide = spark.range(0, 8, 1, 2).select(F.explode(F.sequence(F.lit(1), F.lit(800))).alias("i"), "id") \
        .select((F.col("id") * 800 + F.col("i")).alias("k"), F.lit(0).alias("hot"),
                F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(63)), lambda x: F.sha2(F.concat_ws("-", "id", "i", x), 256))).alias("body"))
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "400k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        for key, most in (("k", 800), ("hot", 3200)):
            held = spread(wide, [key]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("body")).collect()
            assert sum(r.n for r in held) == 6400 and max(r.n for r in held) <= most
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_dedup_keeps_one_row_a_key_by_newest_then_whole_row(spark, adaptive):
    """Null keys are a key, a hot key is one row, ties go to the greatest row."""
    rows = [(None, "r0", 1, "b"), (None, "r0", 2, "a"), (1, None, None, "x"), (1, None, 1, None), (1, None, 1, "y")]
    rows += [(2, "hot", i % 7, f"v{i:04d}") for i in range(3000)] + [(3, f"r{i}", f, "same") for i in range(50) for f in (1, 2)]
    staged = spark.createDataFrame(rows, "app_id int, request_uuid string, fetch int, body string").repartition(8)
    low = lambda v: (v is not None, v)
    best = {}
    for r in rows:
        if r[:2] not in best or (low(r[2]), low(r[3])) > (low(best[r[:2]][2]), low(best[r[:2]][3])):
            best[r[:2]] = r
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = [tuple(r) for r in dedup(staged, ["app_id", "request_uuid"], ("fetch",)).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == len(best) and set(got) == set(best.values())
