"""Header lists: ``array<struct<name, value>>``. Names may repeat; lookups ignore case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _name_is(x: Column, name: str) -> Column:
    return F.lower(x["name"]) == F.lower(F.lit(name))


def header_values(col, name: str) -> Column:
    """``[s.value FOR s IN h IF lower(s.name) = lower(name)]``."""
    return F.transform(F.filter(_c(col), lambda x: _name_is(x, name)), lambda x: x["value"])


def header_value(col, name: str) -> Column:
    """First value of header ``name`` (1-based ``[1]``; NULL when absent)."""
    return F.get(header_values(col, name), 0)


def header_count(col, name: str) -> Column:
    """``len([s FOR s IN h IF ...])``; NULL for a NULL list."""
    c = _c(col)
    # explicit NULL for a NULL list: legacy (non-ANSI) sessions give size(NULL) = -1
    return F.when(c.isNotNull(), F.size(F.filter(c, lambda x: _name_is(x, name)))).cast("bigint")


def header_exists(col, name: str) -> Column:
    """True when header ``name`` is present; False for a NULL list."""
    return F.coalesce(F.exists(_c(col), lambda x: _name_is(x, name)), F.lit(False))


def header_any(col, name: str, pred) -> Column:
    """True when some header ``name`` has a value satisfying ``pred``; False for NULL."""
    return F.coalesce(F.exists(_c(col), lambda x: _name_is(x, name) & pred(x["value"])),
                      F.lit(False))


def reshape_pairs(col) -> Column:
    """Wire-shaped headers (``struct<"1","2">`` or ``[name, value]`` pairs) to
    ``array<struct<name, value>>``; NULL stays NULL."""
    c = _c(col)
    return F.transform(c, lambda x: F.struct(x["1"].alias("name"), x["2"].alias("value")))


def reshape_lists(col) -> Column:
    """``[[name, value], ...]`` to ``array<struct<name, value>>``."""
    return F.transform(_c(col), lambda x: F.struct(F.get(x, 0).alias("name"),
                                                  F.get(x, 1).alias("value")))


def headers_text(col) -> Column:
    """Canonical text of a header list (``name=value`` joined by ``|``) for comparing
    across engines that print nested values differently."""
    return F.array_join(F.transform(_c(col), lambda x: F.concat_ws("=", x["name"], x["value"])), "|")


def headers_from_json(col) -> Column:
    """JSON text ``[{"name": .., "value": ..}, ...]`` to ``array<struct<name, value>>``
    (the implicit cast applied when header lists arrive as JSON text)."""
    return F.from_json(_c(col), "array<struct<name:string,value:string>>")
