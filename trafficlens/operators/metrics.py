"""The metrics operator: scope -> filter -> bucket -> group -> aggregate.

Without percentiles one ``groupBy().agg()`` computes every requested metric: a single
shuffle on (app_id, period, group fields) with map-side partial aggregation. Exact
percentiles add one pre-aggregation on (group, response time) and a running count over
each group's distinct response times (see ``_exact_percentile_agg``), so a group holding a
third of all requests is reduced to its distinct response times before any task sees it.

Decisions where the contract is silent (kept in one place each):
  * percentiles: exact discrete percentile (the ``percentile_disc`` definition, computed
    by ``_exact_percentile_agg``); ``approx=True`` uses ``percentile_approx`` with
    accuracy 10000 in the single aggregate instead.
  * error_rate = (client_errors + server_errors) / requests.
  * bytes_received = sum(request_size_bytes), bytes_sent = sum(response_size_bytes).
  * requests_per_minute uses the real length of the period (23/25-hour DST days).
  * empty buckets are not zero-filled; NULL group values form their own group.
  * expected errors: optional DataFrame (app_id, method, path, status_code) of
    responses that do not count as client/server errors; none by default.
"""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.timerange import ts_lit
from trafficlens.operators.filters import apply_filters
from trafficlens.schemas import GROUP_FIELDS, INTERVALS, METRIC_NAMES

PERCENTILES = {"response_time_p50": 0.5, "response_time_p75": 0.75, "response_time_p90": 0.9,
               "response_time_p95": 0.95, "response_time_p99": 0.99}
_FIXED_SECONDS = {"hour": 3600, "minute": 60}


class MetricsError(ValueError):
    pass


def period_start(ts: Column, interval: str, tz: str = "UTC") -> Column:
    """Start of the ``interval`` bucket holding ``ts`` in zone ``tz`` (as a UTC instant).

    Day and month buckets truncate local wall time and map it back, so DST days are
    23 or 25 hours long. Hour and minute buckets are cut on the UTC axis shifted by the
    zone's offset at ``ts``, which keeps the two fall-back hours apart and handles
    half-hour zones.
    """
    if interval in ("day", "month"):
        if tz == "UTC":
            return F.date_trunc(interval, ts)
        return F.to_utc_timestamp(F.date_trunc(interval, F.from_utc_timestamp(ts, tz)), tz)
    n = _FIXED_SECONDS.get(interval)
    if n is None:
        raise MetricsError(f"unknown interval {interval!r}")
    if tz == "UTC":
        return F.date_trunc(interval, ts)
    return bucket_seconds_start(ts, n, tz)


def bucket_seconds_start(ts: Column, n: int, tz: str = "UTC") -> Column:
    s = F.unix_seconds(ts)
    off = (F.unix_seconds(F.from_utc_timestamp(ts, tz)) - s) if tz != "UTC" else F.lit(0)
    return F.timestamp_seconds(s - F.pmod(s + off, F.lit(n)))


def period_end(start: Column, interval: str, tz: str = "UTC") -> Column:
    if interval in ("day", "month"):
        unit = "DAY" if interval == "day" else "MONTH"
        if tz == "UTC":
            return F.timestamp_add(unit, F.lit(1), start)
        local = F.from_utc_timestamp(start, tz)
        return F.to_utc_timestamp(F.timestamp_add(unit, F.lit(1), local), tz)
    return F.timestamp_seconds(F.unix_seconds(start) + F.lit(_FIXED_SECONDS[interval]))


def _validate(metrics, group_by, interval, tz):
    if not metrics:
        raise MetricsError("at least one metric is required")
    bad = [m for m in metrics if m not in METRIC_NAMES]
    if bad:
        raise MetricsError(f"unknown metrics: {bad}")
    bad = [g for g in group_by if g not in GROUP_FIELDS]
    if bad:
        raise MetricsError(f"unknown group-by fields: {bad}")
    if interval is not None and interval not in INTERVALS:
        raise MetricsError(f"interval must be one of {INTERVALS}")
    try:
        ZoneInfo(tz)
    except Exception as e:  # noqa: BLE001
        raise MetricsError(f"unknown time zone {tz!r}") from e


def _flag_expected(df: DataFrame, expected: DataFrame | None) -> DataFrame:
    if expected is None:
        return df.withColumn("_expected", F.lit(False))
    keys = ["app_id", "method", "path", "status_code"]
    exp = expected.select(*keys).distinct().withColumn("_expected", F.lit(True))
    out = df.join(exp, keys, "left")
    return out.withColumn("_expected", F.coalesce(F.col("_expected"), F.lit(False)))


def metrics(df: DataFrame, metrics: list[str], *, app_id=None, since=None, until=None,
            interval: str | None = None, group_by: list[str] | None = None, filters=None,
            timezone_name: str = "UTC", expected_errors: DataFrame | None = None,
            approx: bool = False, now: datetime | None = None,
            bucket_seconds: int | None = None) -> DataFrame:
    """Aggregate ``request_logs``-shaped ``df`` into metrics rows.

    Output columns: app_id, period_start, period_end, the requested group fields and
    the requested metrics, in canonical order. ``bucket_seconds`` replaces ``interval``
    by fixed-width UTC buckets (used by rollups).
    """
    group_by = list(group_by or [])
    tz = timezone_name
    _validate(metrics, group_by, interval, tz)
    now = now or datetime.now(timezone.utc)

    if interval is None and bucket_seconds is None and since is None:
        raise MetricsError("since is required when no interval is given")
    if since is not None and until is None:
        until = now

    d = df
    if app_id is not None:
        ids = list(app_id) if isinstance(app_id, (list, tuple, set)) else [app_id]
        d = d.filter(F.col("app_id").isin(*ids))
    if since is not None:
        d = d.filter(F.col("timestamp") >= ts_lit(since, tz, now))
    if until is not None:
        d = d.filter(F.col("timestamp") < ts_lit(until, tz, now))
    d = apply_filters(d, filters, "metrics")

    wants = set(metrics)
    need_errors = bool(wants & {"client_errors", "server_errors", "error_rate"})
    if need_errors:
        d = _flag_expected(d, expected_errors)

    if bucket_seconds is not None:
        d = d.withColumn("period_start", bucket_seconds_start(F.col("timestamp"), bucket_seconds))
    elif interval is not None:
        d = d.withColumn("period_start", period_start(F.col("timestamp"), interval, tz))
    keys = ["app_id"] + (["period_start"] if (interval or bucket_seconds) else []) + \
        [g for g in GROUP_FIELDS if g in group_by]

    status = F.col("status_code")
    ok = ~F.col("_expected") if need_errors else F.lit(True)
    pcts = [m for m in metrics if m in PERCENTILES]
    exact = bool(pcts) and not approx
    # Additive parts. With exact percentiles they are first summed per
    # (group, response time) and summed again per group afterwards.
    parts = []
    if wants & {"requests", "requests_per_minute", "error_rate"}:
        parts.append(("requests", F.count(F.lit(1))))
    if "bytes_received" in wants:
        parts.append(("bytes_received", F.sum("request_size_bytes")))
    if "bytes_sent" in wants:
        parts.append(("bytes_sent", F.sum("response_size_bytes")))
    if need_errors:
        parts.append(("client_errors", F.count_if(status.between(400, 499) & ok)))
        parts.append(("server_errors", F.count_if((status >= 500) & ok)))

    if exact:
        g = _exact_percentile_agg(d, keys, parts, pcts)
    else:
        aggs = [e.cast("bigint").alias(n) for n, e in parts]
        if pcts:
            aggs.append(F.percentile_approx("response_time_ms", [PERCENTILES[m] for m in pcts],
                                            10000).alias("_pcts"))
        g = d.groupBy(*keys).agg(*aggs)

    if bucket_seconds is not None:
        g = g.withColumn("period_end", F.timestamp_seconds(
            F.unix_seconds("period_start") + F.lit(bucket_seconds)))
    elif interval is not None:
        g = g.withColumn("period_end", period_end(F.col("period_start"), interval, tz))
    else:
        g = g.withColumn("period_start", ts_lit(since, tz, now)) \
             .withColumn("period_end", ts_lit(until, tz, now))

    out = []
    for gcol in GROUP_FIELDS:
        if gcol in group_by:
            c = F.col(gcol).cast("bigint") if gcol == "consumer_id" else F.col(gcol)
            out.append(c.alias(gcol))
    for m in METRIC_NAMES:
        if m not in wants:
            continue
        if m == "requests_per_minute":
            minutes = (F.unix_seconds("period_end") - F.unix_seconds("period_start")) / F.lit(60.0)
            out.append((F.col("requests") / minutes).alias(m))
        elif m == "error_rate":
            out.append(((F.col("client_errors") + F.col("server_errors")) / F.col("requests"))
                       .alias(m))
        elif m in PERCENTILES and not exact:
            out.append(F.col("_pcts")[pcts.index(m)].cast("int").alias(m))
        else:
            out.append(F.col(m))
    return g.select("app_id", "period_start", "period_end", *out)


def _exact_percentile_agg(d: DataFrame, keys: list[str], parts, pcts) -> DataFrame:
    """Exact discrete percentiles without per-group value maps.

    1. ``groupBy(keys, response_time_ms)``: one row per distinct response time of a group
       with its count and the additive parts (partial aggregation map-side).
    2. A window over each group's distinct response times, ascending, gives the running
       count; the p-th percentile is the smallest value whose running count reaches
       ``ceil(n * p)`` (n = non-null response times of the group), which is the
       cumulative-distribution definition of ``percentile_disc``.
    3. ``groupBy(keys)`` sums the parts and picks the percentiles; it reuses the window's
       partitioning, so the plan has two exchanges of pre-aggregated rows.
    A group holding a third of all requests costs as many window rows as it has distinct
    response times, not requests. All buffers are fixed-width (Tungsten hash aggregation).
    """
    rt = F.col("response_time_ms")
    stage1 = d.groupBy(*keys, "response_time_ms").agg(
        F.count(rt).alias("_c"), *[e.alias(f"_p_{n}") for n, e in parts])
    running = Window.partitionBy(*keys).orderBy("response_time_ms") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stage2 = (stage1.withColumn("_cum", F.sum("_c").over(running))
              .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys))))
    aggs = [F.sum(f"_p_{n}").cast("bigint").alias(n) for n, _ in parts]
    for m in pcts:
        reach = F.ceil(F.col("_n") * F.lit(PERCENTILES[m]))
        aggs.append(F.min(F.when(rt.isNotNull() & (F.col("_cum") >= reach), rt))
                    .cast("int").alias(m))
    return stage2.groupBy(*keys).agg(*aggs)


def reaggregate(metrics_df: DataFrame, group_by: list[str], since=None, until=None,
                app_id=None, sums: tuple[str, ...] | list[str] = ("requests",)) -> DataFrame:
    """Re-aggregate stored metrics rows: ``<metric>_sum`` of each of ``sums``, which must be
    additive (see ``ADDITIVE``)."""
    bad = [m for m in sums if m not in ADDITIVE]
    if bad:
        raise MetricsError(f"not additive: {bad}")
    d = metrics_df
    if app_id is not None:
        d = d.filter(F.col("app_id") == F.lit(app_id))
    if since is not None:
        d = d.filter(F.col("period_start") >= ts_lit(since))
    if until is not None:
        d = d.filter(F.col("period_end") <= ts_lit(until))
    return d.groupBy(*group_by).agg(*[F.sum(m).cast("bigint").alias(f"{m}_sum") for m in sums])


ADDITIVE = ["requests", "bytes_received", "bytes_sent", "client_errors", "server_errors"]


# Retained items of a stored percentile sketch: the rank error is below 0.1 % (exact up to as many rows).
SKETCH_K = 4096
SKETCH = "response_time_sketch"
QUANTILES = {"response_time_p50": 0.5, "response_time_p75": 0.75, "response_time_p90": 0.9, "response_time_p95": 0.95, "response_time_p99": 0.99}


def response_time_sketches(logs: DataFrame, seconds: int = 60, group_by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """(app_id, period_start, group fields, SKETCH): a mergeable KLL sketch of the response times of
    each ``seconds``-wide bucket, to be stored beside its metrics rows; logs are kept for days,
    rollups for months. A bucket without response times has a NULL sketch."""
    start = bucket_seconds_start(F.col("timestamp"), seconds)
    sketch = F.kll_sketch_agg_bigint(F.col("response_time_ms").cast("bigint"), F.lit(k))
    return (logs.groupBy("app_id", start.alias("period_start"), *(group_by or []))
            .agg(F.when(F.count("response_time_ms") > 0, sketch).alias(SKETCH)))


def rollup(metrics_df: DataFrame, seconds: int = 1800,
           group_by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """Roll stored fine-grained metrics (e.g. 1-minute) into ``seconds``-wide buckets.

    Additive metrics are summed and the two ratios recomputed from them. Where the rows carry
    a SKETCH column, the sketches are merged, kept for the next tier, and give p50 to p99 (the
    smallest response time that reaches the rank; exact up to ``k`` rows a bucket, else within the
    sketch's rank error).
    """
    group_by = list(group_by or [])
    start = bucket_seconds_start(F.col("period_start"), seconds)
    sketched = SKETCH in metrics_df.columns
    merged = [F.when(F.count(SKETCH) > 0, F.kll_merge_agg_bigint(SKETCH, F.lit(k))).alias(SKETCH)] if sketched else []
    g = (metrics_df.withColumn("period_start", start)
         .groupBy("app_id", "period_start", *group_by)
         .agg(*[F.sum(m).cast("bigint").alias(m) for m in ADDITIVE], *merged))
    quantiles = [F.kll_sketch_get_quantile_bigint(SKETCH, F.lit(p)).cast("int").alias(name) for name, p in QUANTILES.items()] if sketched else []
    return (g.withColumn("period_end", F.timestamp_seconds(F.unix_seconds("period_start") + seconds))
            .withColumn("requests_per_minute", F.col("requests") / F.lit(seconds / 60.0))
            .withColumn("error_rate", (F.col("client_errors") + F.col("server_errors"))
                        / F.col("requests"))
            .select("app_id", "period_start", "period_end", *group_by, "requests",
                    "requests_per_minute", *ADDITIVE[1:], "error_rate", *quantiles, *([SKETCH] if sketched else [])))
