from datetime import datetime, timedelta, timezone

import pytest

from trafficlens.functions.timerange import relative_seconds, resolve_instant

NOW = datetime(2025, 6, 1, 12, 0, tzinfo=timezone.utc)


@pytest.mark.parametrize("text,secs", [
    ("30m", 1800), ("2h", 7200), ("3d", 259_200), ("1w", 604_800), ("P14D", 14 * 86_400),
    ("-P14D", 14 * 86_400), ("p14d", 14 * 86_400), ("-2H", 7200), ("PT24H", 86_400),
    ("PT30M", 1800), ("-PT30M", 1800), ("P1M", 60),
])
def test_relative_forms(text, secs):
    assert relative_seconds(text) == secs
    assert resolve_instant(text, now=NOW) == NOW - timedelta(seconds=secs)


@pytest.mark.parametrize("text", ["99999999999999999999d", "99999999999999d", "3000000d"])
def test_too_long(text):
    with pytest.raises(ValueError, match="out of range"):
        resolve_instant(text, now=NOW)


@pytest.mark.parametrize("text", ["1h30m", "P1Y", "15", "m", "", "2025-01-01T00:00:00Z"])
def test_not_relative(text):
    assert relative_seconds(text) is None


def test_iso_unchanged_and_zone_less():
    assert resolve_instant("2025-01-01T00:00:00Z") == datetime(2025, 1, 1, tzinfo=timezone.utc)
    # zone-less values are read in the given zone
    assert resolve_instant("2025-01-01T00:00:00", tz="America/New_York") == \
        datetime(2025, 1, 1, 5, tzinfo=timezone.utc)


def test_bad_datetime():
    with pytest.raises(ValueError):
        resolve_instant("yesterday")
