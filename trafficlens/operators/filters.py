"""Typed filter grammar: a JSON array of ``{field, op, value?, key?}`` objects, ANDed.

``compile_filters(filters, kind)`` validates every object against the field's type class
and returns one boolean Column built from JVM expressions, so Catalyst can push simple
comparisons into the Parquet scan. NULL handling follows SQL three-valued logic: a row
whose field is NULL drops out of ``neq`` and the ``not_*`` string operators.
Header operators look at ``array<struct<name, value>>`` lists with a case-insensitive
name; negative value operators are the negation of the positive one.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.functions.headers import header_any, header_exists
from trafficlens.functions.timerange import ts_lit
from trafficlens.schemas import LOG_FIELD_TYPES, LOG_OPS, METRIC_FILTER_TYPES, METRIC_OPS

# A character no pattern uses, passed as the LIKE escape so that ``\`` is literal.
LIKE_ESCAPE = "\u0001"


class FilterError(ValueError):
    """An input error in a filter list."""


def _like(c: Column, pattern: str) -> Column:
    return F.like(c, F.lit(pattern), F.lit(LIKE_ESCAPE))


def _ilike(c: Column, pattern: str) -> Column:
    return F.ilike(c, F.lit(pattern), F.lit(LIKE_ESCAPE))


def _contains_ci(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(text)))


_POSITIVE = {"neq": "eq", "not_in": "in", "not_like": "like", "not_ilike": "ilike",
             "not_contains": "contains"}


def _check_value(field: str, tclass: str, op: str, value):
    if op in ("is_null", "is_not_null", "exists", "not_exists"):
        return None
    if value is None:
        raise FilterError(f"filter on {field!r} with op {op!r} needs a value")
    if op in ("in", "not_in"):
        if not isinstance(value, list) or not value:
            raise FilterError(f"op {op!r} on {field!r} needs a non-empty JSON array")
        return [_check_scalar(field, tclass, op, v) for v in value]
    return _check_scalar(field, tclass, op, value)


def _check_scalar(field, tclass, op, v):
    if tclass in ("int", "int_id", "mint"):
        if isinstance(v, bool) or not isinstance(v, int):
            raise FilterError(f"field {field!r} needs an integer value, got {v!r}")
        return v
    if tclass == "datetime":
        if not isinstance(v, str):
            raise FilterError(f"field {field!r} needs an ISO 8601 datetime string")
        return v
    if not isinstance(v, str):
        raise FilterError(f"field {field!r} needs a string value, got {v!r}")
    return v


def _value_pred(op: str, value, tclass: str):
    """Positive predicate builder ``f(column) -> Column`` for a scalar-valued op."""
    if tclass == "datetime":
        lit = ts_lit(value)
    else:
        lit = None
    if op == "eq":
        return lambda c: c == (lit if lit is not None else F.lit(value))
    if op == "gt":
        return lambda c: c > (lit if lit is not None else F.lit(value))
    if op == "gte":
        return lambda c: c >= (lit if lit is not None else F.lit(value))
    if op == "lt":
        return lambda c: c < (lit if lit is not None else F.lit(value))
    if op == "lte":
        return lambda c: c <= (lit if lit is not None else F.lit(value))
    if op == "in":
        return lambda c: c.isin(*value)
    if op == "like":
        return lambda c: _like(c, value)
    if op == "ilike":
        return lambda c: _ilike(c, value)
    if op == "contains":
        return lambda c: _contains_ci(c, value)
    raise FilterError(f"unsupported op {op!r}")


def compile_one(flt: dict, kind: str = "logs") -> Column:
    if not isinstance(flt, dict):
        raise FilterError(f"each filter must be an object, got {flt!r}")
    field, op = flt.get("field"), flt.get("op")
    types = LOG_FIELD_TYPES if kind == "logs" else METRIC_FILTER_TYPES
    ops = LOG_OPS if kind == "logs" else METRIC_OPS
    if field not in types:
        raise FilterError(f"unknown filter field {field!r}")
    tclass = types[field]
    if op not in ops[tclass]:
        raise FilterError(f"op {op!r} is not allowed for field {field!r}")
    value = _check_value(field, tclass, op, flt.get("value"))
    c = F.col(field)

    if tclass == "headers":
        key = flt.get("key")
        if not isinstance(key, str) or not key:
            raise FilterError(f"header filter on {field!r} needs a 'key'")
        if op == "exists":
            return header_exists(c, key)
        if op == "not_exists":
            return ~header_exists(c, key)
        pos = _POSITIVE.get(op, op)
        cond = header_any(c, key, _value_pred(pos, value, tclass))
        return ~cond if op in _POSITIVE else cond

    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op in _POSITIVE:
        return ~_value_pred(_POSITIVE[op], value, tclass)(c)
    return _value_pred(op, value, tclass)(c)


def parse_filters(filters) -> list[dict]:
    if filters is None:
        return []
    if isinstance(filters, str):
        try:
            filters = json.loads(filters)
        except ValueError as e:
            raise FilterError(f"filters are not valid JSON: {e}") from e
    if isinstance(filters, dict):
        filters = [filters]
    if not isinstance(filters, list):
        raise FilterError("filters must be a JSON array of filter objects")
    return filters


def compile_filters(filters, kind: str = "logs") -> Column:
    """AND of all filters (``lit(True)`` for none). ``kind`` is ``logs`` or ``metrics``."""
    parts = [compile_one(f, kind) for f in parse_filters(filters)]
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def apply_filters(df, filters, kind: str = "logs"):
    parts = [compile_one(f, kind) for f in parse_filters(filters)]
    return df.filter(reduce(lambda a, b: a & b, parts)) if parts else df
