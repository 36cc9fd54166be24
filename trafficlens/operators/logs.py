"""The request-log query: scope -> filter -> sample -> sort -> limit -> project.

Sampling is a hash predicate on ``request_uuid`` (first 15 hex digits of its MD5 below
``rate * 2^60``): deterministic, independent of partitioning and of other rows, so it is
an ordinary filter that runs inside the scan stage. A sample *size* becomes a rate through
one scalar subquery (the filtered row count), planned by Spark, not a driver loop.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.timerange import ts_lit
from trafficlens.operators.filters import apply_filters
from trafficlens.schemas import (ALWAYS_LOG_FIELDS, DEFAULT_LOG_FIELDS, LOG_FIELD_NAMES,
                                 MAX_SAMPLE_RATE)


class LogQueryError(ValueError):
    pass


def select_fields(fields: list[str] | None = None) -> list[str]:
    """Requested fields plus the always-included ones, in canonical order; the default
    set when ``fields`` is None."""
    if fields is None:
        return list(DEFAULT_LOG_FIELDS)
    bad = [f for f in fields if f not in LOG_FIELD_NAMES]
    if bad:
        raise LogQueryError(f"unknown fields: {bad}")
    wanted = set(fields) | set(ALWAYS_LOG_FIELDS)
    return [f for f in LOG_FIELD_NAMES if f in wanted]


# Hex digits of the hash compared: 60 bits resolve any rate a sample of one row in 10^15 needs.
_DIGITS = 15


def _hash_digits(c: Column) -> Column:
    return F.substring(F.md5(c.cast("string")), 1, _DIGITS)


def sample_rate_predicate(rate: float, key: str = "request_uuid") -> Column:
    if not (0 < rate <= MAX_SAMPLE_RATE):
        raise LogQueryError(f"sample rate must be > 0 and <= {MAX_SAMPLE_RATE}")
    threshold = int(rate * 16**_DIGITS)
    return _hash_digits(F.col(key)) < F.lit(f"{threshold:0{_DIGITS}x}")


def sample_size_predicate(df: DataFrame, size: int, key: str = "request_uuid") -> Column:
    """Keep about ``size`` rows of ``df``: rate = size / count(df), capped at 1."""
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise LogQueryError("sample size must be an integer >= 1")
    n = df.select(F.count(F.lit(1)).alias("n")).scalar()
    rate = F.least(F.lit(1.0), F.lit(float(size)) / n)
    threshold = F.floor(rate * F.lit(float(16**_DIGITS))).cast("bigint")
    hex_t = F.lpad(F.lower(F.hex(threshold)), _DIGITS, "0")
    return (rate >= F.lit(1.0)) | (_hash_digits(F.col(key)) < hex_t)


def request_logs(df: DataFrame, *, app_id=None, since=None, until=None,
                 fields: list[str] | None = None, filters=None, sample_rate: float | None = None,
                 sample_size: int | None = None, limit: int | None = None,
                 now: datetime | None = None, ordered: bool = True,
                 keep_app_id: bool = False) -> DataFrame:
    """Request logs of ``df`` (``request_logs`` schema) as the fields asked for.

    Zone-less since/until are UTC. Rows come ordered by timestamp (request_uuid breaks
    ties). With a ``limit`` the sort becomes a top-k (TakeOrderedAndProject) instead of a
    global sort; any limit is honoured. ``keep_app_id`` adds app_id in
    front (for joins on the composite keys).
    """
    cols = (["app_id"] if keep_app_id else []) + select_fields(fields)
    if since is not None and until is None:
        until = now or datetime.now(timezone.utc)
    d = df
    if app_id is not None:
        ids = list(app_id) if isinstance(app_id, (list, tuple, set)) else [app_id]
        d = d.filter(F.col("app_id").isin(*ids))
    if since is not None:
        d = d.filter(F.col("timestamp") >= ts_lit(since, "UTC", now))
    if until is not None:
        d = d.filter(F.col("timestamp") < ts_lit(until, "UTC", now))
    d = apply_filters(d, filters, "logs")
    if sample_rate is not None and sample_size is not None:
        raise LogQueryError("give either sample_rate or sample_size")
    if sample_rate is not None:
        d = d.filter(sample_rate_predicate(sample_rate))
    elif sample_size is not None:
        d = d.filter(sample_size_predicate(d, sample_size))
    if limit is not None:
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
            raise LogQueryError("limit must be an integer >= 1")
        d = d.orderBy("timestamp", "request_uuid").limit(limit)
    elif ordered:
        d = d.orderBy("timestamp", "request_uuid")
    return d.select(*cols)


def endpoints_filter(endpoints: DataFrame, method: str | None = None,
                     path: str | None = None) -> DataFrame:
    """Endpoints by comma-separated ``method`` list and a ``*``-wildcard ``path``,
    ordered by path and method."""
    d = endpoints
    if method:
        ms = [m.strip().upper() for m in method.split(",") if m.strip()]
        d = d.filter(F.upper(F.col("method")).isin(*ms))
    if path:
        esc = "\\"
        pat = "".join("%" if ch == "*" else (esc + ch if ch in "%_\\" else ch) for ch in path)
        d = d.filter(F.like(F.col("path"), F.lit(pat), F.lit(esc)))
    return d.orderBy("path", "method")


def consumers_since(consumers: DataFrame, requests_since, now: datetime | None = None,
                    app_id=None) -> DataFrame:
    d = consumers if app_id is None else consumers.filter(F.col("app_id") == F.lit(app_id))
    return d.filter(F.col("last_request_at") >= ts_lit(requests_since, "UTC", now))


__all__ = ["request_logs", "select_fields", "sample_rate_predicate", "sample_size_predicate",
           "endpoints_filter", "consumers_since"]
