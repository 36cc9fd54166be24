"""Time parameters: relative durations, zone-less instants, range filters."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit letters of a compact duration and their length in seconds.
_UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86_400, "w": 604_800}
_DURATION = re.compile(r"[-pt]*(?P<count>[0-9]+)(?P<unit>[mhdw])", re.IGNORECASE)


def relative_seconds(text: str) -> int | None:
    """Seconds of a compact duration (``30m``, ``7d``, ``P14D``, ``-PT30M``), else None.

    Case-insensitive; any leading run of ``-``, ``p``, ``t`` is ignored and ``m`` always
    means minutes. Compound forms (``1h30m``), years and bare numbers are not durations.
    """
    found = _DURATION.fullmatch(text)
    return int(found["count"]) * _UNIT_SECONDS[found["unit"].lower()] if found else None


def resolve_instant(value, tz: str = "UTC", now: datetime | None = None) -> datetime:
    """An aware UTC datetime for ``value``: a datetime, a relative duration (now minus
    it), or an ISO 8601 text. Zone-less values are read in ``tz``."""
    now = now or datetime.now(timezone.utc)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    if isinstance(value, datetime):
        dt = value
    else:
        secs = relative_seconds(str(value))
        if secs is not None:
            try:
                return (now - timedelta(seconds=secs)).astimezone(timezone.utc)
            except OverflowError as e:
                raise ValueError(f"duration out of range: {value!r}") from e
        txt = str(value).strip()
        if txt.endswith(("Z", "z")):
            txt = txt[:-1] + "+00:00"
        try:
            dt = datetime.fromisoformat(txt)
        except ValueError as e:
            raise ValueError(f"invalid datetime: {value!r}") from e
    if dt.tzinfo is None:
        dt = dt.replace(tzinfo=ZoneInfo(tz))
    return dt.astimezone(timezone.utc)


def ts_lit(value, tz: str = "UTC", now: datetime | None = None) -> Column:
    """A TIMESTAMP literal for ``value`` (see ``resolve_instant``). Being a literal on
    the bare column, range predicates built from it reach the Parquet scan."""
    dt = resolve_instant(value, tz, now)
    return F.lit(dt.strftime("%Y-%m-%dT%H:%M:%S.%fZ")).cast("timestamp")


def in_range(col: str | Column, since=None, until=None, tz: str = "UTC",
             now: datetime | None = None) -> Column:
    """``since <= col < until``; either bound may be omitted."""
    c = F.col(col) if isinstance(col, str) else col
    cond = F.lit(True)
    if since is not None:
        cond = cond & (c >= ts_lit(since, tz, now))
    if until is not None:
        cond = cond & (c < ts_lit(until, tz, now))
    return cond


def retention(df, keep: timedelta, now, time_col: str = "timestamp"):
    """Rows younger than ``keep`` at ``now`` (logs 15 days; minute metrics 30 days;
    30-minute metrics 13 months)."""
    now = resolve_instant(now)
    return df.filter(F.col(time_col) >= ts_lit(now - keep))
