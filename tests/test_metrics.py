from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trafficlens.operators.metrics import MetricsError, metrics
from trafficlens.schemas import REQUEST_LOGS
from trafficlens.sources.testtables import register_views


def _rows(spark, stamps):
    data = []
    for i, (ts, status, rt) in enumerate(stamps):
        data.append((1, ts, f"u{i}", "prod", "GET", "/p", "https://x", 1, None, 10, None, status,
                     rt, None, 20, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(data, REQUEST_LOGS)


def utc(*a):
    return datetime(*a, tzinfo=timezone.utc)


def test_dst_fall_back_hours_stay_apart(spark):
    df = _rows(spark, [(utc(2025, 11, 2, 5, 30), 200, 1), (utc(2025, 11, 2, 6, 30), 200, 1)])
    out = metrics(df, ["requests"], interval="hour", timezone_name="America/New_York") \
        .orderBy("period_start").collect()
    assert [r.period_start.hour for r in out] == [5, 6]


def test_dst_spring_forward_day_is_23h(spark):
    df = _rows(spark, [(utc(2025, 3, 9, 12), 200, 1)])
    r = metrics(df, ["requests", "requests_per_minute"], interval="day",
                timezone_name="America/New_York").collect()[0]
    assert (r.period_end - r.period_start).total_seconds() == 23 * 3600
    assert r.requests_per_minute == pytest.approx(1 / (23 * 60))


def test_half_hour_zone(spark):
    df = _rows(spark, [(utc(2025, 1, 5, 10, 10), 200, 1)])
    r = metrics(df, ["requests"], interval="hour", timezone_name="Asia/Kolkata").collect()[0]
    assert (r.period_start.hour, r.period_start.minute) == (9, 30)


def test_month_bucket_local(spark):
    df = _rows(spark, [(utc(2025, 2, 1, 3), 200, 1)])  # still January in New York
    r = metrics(df, ["requests"], interval="month", timezone_name="America/New_York").collect()[0]
    assert (r.period_start.month, r.period_start.day, r.period_start.hour) == (1, 1, 5)


def test_validation(spark):
    df = _rows(spark, [(utc(2025, 1, 1), 200, 1)])
    with pytest.raises(MetricsError):
        metrics(df, ["nope"], interval="day")
    with pytest.raises(MetricsError):
        metrics(df, ["requests"], interval="week")
    with pytest.raises(MetricsError):
        metrics(df, ["requests"], group_by=["url"], interval="day")
    with pytest.raises(MetricsError):
        metrics(df, ["requests"])  # no interval needs since


def test_against_pandas_brute_force(spark):
    """All twelve metrics per hour and endpoint equal a pandas computation."""
    v = register_views(spark, "/root/testdata/sf0.001")
    names = ["requests", "requests_per_minute", "bytes_received", "bytes_sent", "client_errors",
             "server_errors", "error_rate", "response_time_p50", "response_time_p75",
             "response_time_p90", "response_time_p95", "response_time_p99"]
    got = metrics(v["request_logs"], names, interval="hour", group_by=["method", "path"]) \
        .withColumn("period_start", F.col("period_start").cast("timestamp_ntz")) \
        .toPandas().sort_values(["app_id", "period_start", "method", "path"]).reset_index(drop=True)
    raw = v["request_logs"].select("app_id", F.col("timestamp").cast("timestamp_ntz").alias("ts"),
                                   "method", "path", "status_code", "response_time_ms",
                                   "request_size_bytes", "response_size_bytes").toPandas()
    raw["period_start"] = raw.ts.dt.floor("h")

    def disc(s, p):
        v = sorted(s)
        import math
        return v[max(0, math.ceil(p * len(v)) - 1)]

    rows = []
    for k, g in raw.groupby(["app_id", "period_start", "method", "path"]):
        n = len(g)
        ce = int(((g.status_code >= 400) & (g.status_code <= 499)).sum())
        se = int((g.status_code >= 500).sum())
        rows.append(dict(zip(["app_id", "period_start", "method", "path"], k),
                         requests=n, requests_per_minute=n / 60, bytes_received=g.request_size_bytes.sum(),
                         bytes_sent=g.response_size_bytes.sum(), client_errors=ce, server_errors=se,
                         error_rate=(ce + se) / n,
                         **{f"response_time_p{int(p * 100)}": disc(g.response_time_ms, p)
                            for p in (0.5, 0.75, 0.9, 0.95, 0.99)}))
    exp = pd.DataFrame(rows).sort_values(["app_id", "period_start", "method", "path"]) \
        .reset_index(drop=True)
    assert len(got) == len(exp)
    for c in names:
        assert got[c].astype(float).round(9).tolist() == exp[c].astype(float).round(9).tolist(), c


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["GET", "POST", "PUT"]),
                          st.one_of(st.none(), st.integers(min_value=0, max_value=40))),
                min_size=1, max_size=60))
def test_exact_percentiles_equal_percentile_disc(spark, rows):
    """The pre-aggregated running-count percentiles equal Spark's percentile_disc, with
    NULL response times (ignored by percentiles, counted as requests) and repeated values."""
    data = [(1, utc(2025, 1, 1, 10), f"u{i}", "prod", m, "/p", "https://x", 1, None, 10, None,
             200, rt, None, 20, None, None, None, None, None, None, None, None)
            for i, (m, rt) in enumerate(rows)]
    df = spark.createDataFrame(data, REQUEST_LOGS)
    names = ["requests", "response_time_p50", "response_time_p75", "response_time_p90",
             "response_time_p95", "response_time_p99"]
    got = {r.method: tuple(r[n] for n in names)
           for r in metrics(df, names, interval="hour", group_by=["method"]).collect()}
    df.createOrReplaceTempView("pct_fixture")
    exp_rows = spark.sql("""SELECT method, count(*) AS requests, """ + ", ".join(
        f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY response_time_ms) AS INT) AS p{i}"
        for i, p in enumerate([0.5, 0.75, 0.9, 0.95, 0.99])) +
        " FROM pct_fixture GROUP BY method").collect()
    exp = {r.method: tuple(r[1:]) for r in exp_rows}
    assert got == exp
