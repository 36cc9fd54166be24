"""JSON functions over text columns (request/response bodies, span attributes).

Built on Spark's VARIANT type, which tells a JSON ``null`` from a missing path and
reports value types. Malformed text is treated like a missing value (``try_parse_json``).
Paths are JSONPath texts starting with ``$``: ``$.a``, ``$.a.b``, ``$.a[0]``. The extract
functions also take one last-element (``[#-1]``) or wildcard (``[*]``) step, with or without
a path after it; a wildcard gives a list, empty when nothing matches. NULL text gives NULL.
"""

from __future__ import annotations

import json as _json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def variant_at(col, path: str = "$") -> Column:
    """The value at ``path`` as VARIANT; SQL NULL when missing or malformed."""
    return F.try_variant_get(F.try_parse_json(_c(col)), path, "variant")


def json_exists(col, path: str) -> Column:
    """True when ``path`` exists, also when it holds JSON null; NULL for NULL input."""
    c = _c(col)
    # NULL text -> NULL; written without a CASE around the parse so that Spark's
    # subexpression elimination can share one parse among several JSON functions.
    return variant_at(c, path).isNotNull() | F.when(c.isNull(), F.lit(None)).otherwise(F.lit(False))


_STEP = re.compile(r"^(?P<base>.*?)\[(?P<step>\*|#-1)\](?P<tail>.*)$")


def _stepped(path: str) -> tuple[str, str, str] | None:
    """(path before, ``*`` or ``#-1``, path after) of a path with such a step."""
    m = _STEP.match(path)
    if m and _STEP.match(m["tail"]):
        raise ValueError(f"one [*] or [#-1] step at most: {path!r}")
    return (m["base"], m["step"], m["tail"]) if m else None


def _elements(c: Column, base: str) -> Column:
    """Texts of the elements of the array at ``base``: strings unquoted, containers as written."""
    return F.from_json(F.get_json_object(c, base), "array<string>")


def _step_values(c: Column, base: str, step: str, tail: str, value) -> Column:
    """``value(element text)`` at one step: the last element's, or the list of all matches."""
    if step == "#-1":
        return value(F.try_element_at(_elements(c, base), F.lit(-1)))
    found = F.transform(_elements(c, base), value)
    if tail:
        found = F.filter(found, lambda x: x.isNotNull())
    return F.when(c.isNotNull(), F.coalesce(found, F.array().cast("array<string>")))


def json_extract(col, path: str) -> Column:
    """``->``: the JSON text at ``path`` (strings stay quoted); NULL when missing. With a
    ``[*]`` step, the list of JSON texts."""
    c = _c(col)
    step = _stepped(path)
    if step:
        base, kind, tail = step
        if tail:
            return _step_values(c, *step, lambda x: json_extract(x, "$" + tail))
        variants = F.try_variant_get(F.try_parse_json(c), base, "array<variant>")
        texts = F.zip_with(_elements(c, base), variants, lambda raw, v: _variant_json(v, raw))
        return (F.try_element_at(texts, F.lit(-1)) if kind == "#-1"
                else F.when(c.isNotNull(), F.coalesce(texts, F.array().cast("array<string>"))))
    return _variant_json(variant_at(c, path), F.get_json_object(c, path))


def _variant_json(v: Column, raw: Column) -> Column:
    """JSON text of ``v``; containers as written in ``raw`` (VARIANT sorts object keys)."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(t.startswith("OBJECT") | t.startswith("ARRAY"), raw)
            .otherwise(F.to_json(v)))


def json_extract_string(col, path: str) -> Column:
    """``->>``: text at ``path``; strings unquoted, containers as JSON, JSON null -> NULL.
    With a ``[*]`` step, the list of texts."""
    c = _c(col)
    step = _stepped(path)
    if step is None:
        return F.get_json_object(c, path)
    tail = step[2]
    return _step_values(c, *step, (lambda x: F.get_json_object(x, "$" + tail)) if tail else (lambda x: x))


def json_extract_many(col, paths: list[str], quoted: bool = False) -> Column:
    """``->>`` (``->`` if ``quoted``) with a list of paths: a list of texts."""
    one = json_extract if quoted else json_extract_string
    return F.when(_c(col).isNotNull(), F.array(*[one(col, p) for p in paths]))


def json_value(col, path: str) -> Column:
    """JSON text of a scalar at ``path``; NULL for objects, arrays, JSON null, missing."""
    v = variant_at(col, path)
    t = F.schema_of_variant(v)
    scalar = ~(t.startswith("OBJECT") | t.startswith("ARRAY") | (t == "VOID"))
    return F.when(v.isNotNull() & scalar, F.to_json(v))


def json_last(col, base_path: str, tail: str = "") -> Column:
    """``$.base[#-1]``: text of the last element of the array at ``base_path``."""
    return json_extract_string(col, f"{base_path}[#-1]" + (f".{tail}" if tail else ""))


def json_all(col, base_path: str, tail: str | None = None) -> Column:
    """``$.base[*]`` (or ``$.base[*].tail``): list of texts, ``[]`` when nothing matches."""
    return json_extract_string(col, f"{base_path}[*]" + (f".{tail}" if tail else ""))


def json_array_length(col, path: str = "$") -> Column:
    """Elements of the array at ``path``; 0 when not an array; NULL when missing."""
    c = _c(col)
    return F.when(json_exists(c, path),
                  F.coalesce(F.json_array_length(F.get_json_object(c, path)), F.lit(0))
                  .cast("bigint"))


def json_keys(col, path: str = "$") -> Column:
    """Keys of the object at ``path`` in document order; ``[]`` for non-objects."""
    c = _c(col)
    return F.when(json_exists(c, path),
                  F.coalesce(F.json_object_keys(F.get_json_object(c, path)),
                             F.array().cast("array<string>")))


def json_type(col, path: str = "$") -> Column:
    """ARRAY, OBJECT, VARCHAR, BIGINT, UBIGINT, DOUBLE, BOOLEAN or NULL (JSON null)."""
    v = variant_at(col, path)
    return _type_name(v)


def _type_name(v: Column) -> Column:
    return _type_from_schema(v, F.schema_of_variant(v))


def json_each(df, col, path: str = "$", alias: str = "item", texts: bool = True):
    """Table function ``json_each``: one output row per element at ``path`` of each input
    row, as a struct column ``alias`` with key, value (JSON text), type and ``v`` (the
    element as VARIANT, for ``variant_text`` without re-parsing). Rows where the
    path is missing or not a container produce nothing (an inner lateral join). Without
    ``texts`` the struct has no value and the text is parsed once, into the VARIANT alone.

    The text is parsed once into a VARIANT column and the container is read at ``path``
    directly as ``array<variant>`` (objects, only when that is NULL, as
    ``map<string,variant>``); the explode carries (key, variant) pairs and value text and
    type name are plain projections of the exploded rows, computed once each.
    """
    tmp = f"_{alias}_"
    c = _c(col)
    d = df.withColumn(tmp + "v", F.try_parse_json(c))
    v = F.col(tmp + "v")
    d = d.withColumn(tmp + "a", F.try_variant_get(v, path, "array<variant>"))
    arr = F.col(tmp + "a")
    if not texts:
        members = F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))
        pairs = F.when(arr.isNotNull(), F.transform(arr, lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("x")))) \
            .otherwise(F.transform(members, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("x"))))
        d = d.withColumn(tmp + "e", F.explode(pairs)).drop(tmp + "v", tmp + "a")
        x = F.col(tmp + "e.x")
        d = d.withColumn(tmp + "xt", F.schema_of_variant(x))
        item = F.struct(F.col(tmp + "e.k").alias("key"), _type_from_schema(x, F.col(tmp + "xt")).alias("type"), x.alias("v"))
        return d.withColumn(alias, item).drop(tmp + "e", tmp + "xt")
    # Element texts as written (VARIANT keeps object keys sorted; the text keeps their
    # document order), aligned with the VARIANT elements by position.
    raw_arr = F.from_json(F.get_json_object(c, path), "array<string>")
    raw_obj = F.from_json(F.get_json_object(c, path), "map<string,string>")
    vmap = F.try_variant_get(v, path, "map<string,variant>")
    pairs = (F.when(arr.isNotNull(),
                    F.arrays_zip(F.transform(arr, lambda x, i: F.struct(
                        i.cast("string").alias("k"), x.alias("x"))).alias("kv"),
                        raw_arr.alias("raw")))
             # objects: keys in document order from the text, each value's VARIANT by key
             .otherwise(F.transform(F.map_keys(raw_obj), lambda k: F.struct(
                 F.struct(k.alias("k"), F.element_at(vmap, k).alias("x")).alias("kv"),
                 F.element_at(raw_obj, k).alias("raw")))))
    d = d.withColumn(tmp + "e", F.explode(pairs)).drop(tmp + "v", tmp + "a")
    x = F.col(tmp + "e.kv.x")
    d = d.withColumn(tmp + "xt", F.schema_of_variant(x))
    xt = F.col(tmp + "xt")
    container = xt.startswith("OBJECT") | xt.startswith("ARRAY")
    value = F.when(container, F.col(tmp + "e.raw")).otherwise(F.to_json(x))
    item = F.struct(F.col(tmp + "e.kv.k").alias("key"), value.alias("value"),
                    _type_from_schema(x, xt).alias("type"), x.alias("v"))
    return d.withColumn(alias, item).drop(tmp + "e", tmp + "xt")


def variant_text(v, path: str) -> Column:
    """``->>`` on a VARIANT value (e.g. ``item.v`` of ``json_each``): text at ``path``,
    strings unquoted, JSON null -> NULL; no re-parse of JSON text. Meant for scalars:
    containers come back as JSON with object keys in sorted order (VARIANT's order), so
    use ``json_extract_string`` on the text when their key order matters."""
    x = F.try_variant_get(_c(v), path, "variant")
    t = F.schema_of_variant(x)
    return (F.when(x.isNull() | (t == "VOID"), F.lit(None).cast("string"))
            .otherwise(F.try_variant_get(x, "$", "string")))


def _type_from_schema(v: Column, t: Column) -> Column:
    """DuckDB's JSON type names from a VARIANT value and its ``schema_of_variant``.
    Integers are UBIGINT when not negative and within 64 unsigned bits (VARIANT keeps those
    above the signed range as DECIMAL(20,0)); other decimals (also ``1.0``, kept without
    places) and floats are DOUBLE."""
    integral_decimal = t.startswith("DECIMAL") & t.endswith(",0)")
    as_dec = F.try_variant_get(v, "$", "decimal(38,0)")
    # t sits in the first (always evaluated) condition, so Spark computes it once per
    # value instead of once per branch; t is NULL exactly when v is.
    return (F.when(v.isNull() | t.isNull(), F.lit(None).cast("string"))
            .when(t.startswith("ARRAY"), F.lit("ARRAY"))
            .when(t.startswith("OBJECT"), F.lit("OBJECT"))
            .when(t == "VOID", F.lit("NULL"))
            .when(t == "STRING", F.lit("VARCHAR"))
            .when(t == "BIGINT",
                  F.when(F.try_variant_get(v, "$", "bigint") >= 0, F.lit("UBIGINT"))
                  .otherwise(F.lit("BIGINT")))
            .when(integral_decimal & (as_dec > F.lit((1 << 63) - 1).cast("decimal(20,0)")) & (as_dec <= F.lit("18446744073709551615").cast("decimal(20,0)")),
                  F.lit("UBIGINT"))
            .when(t.startswith("DECIMAL") | (t == "FLOAT") | (t == "DOUBLE"), F.lit("DOUBLE"))
            .otherwise(t))


# ---------------------------------------------------------------------------------
# json_contains: no built-in. The values of a document, level by level, as VARIANTs; the
# needle is compiled into one expression over a value.
# ---------------------------------------------------------------------------------

def _children(v: Column) -> Column:
    """The elements or members' values of ``v``; NULL for a scalar."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"),
                      F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))


def _all_values(c: Column) -> Column:
    """Every value of a JSON text, at any depth: ``array<variant>``; NULL for malformed text.

    A fold over levels, each the children of the one before. A text has no more levels than
    opening brackets; rounds after the last level change nothing."""
    root = F.try_parse_json(c)
    brackets = F.length(c) - F.length(F.translate(c, "[{", ""))
    start = F.struct(F.array(root).alias("all"), F.array(root).alias("level"))

    def deeper(acc: Column, _round: Column) -> Column:
        below = F.flatten(F.filter(F.transform(acc["level"], _children), lambda x: x.isNotNull()))
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(
            F.struct(F.concat(acc["all"], below).alias("all"), below.alias("level")))

    values = F.aggregate(F.sequence(F.lit(0), brackets), start, deeper, lambda acc: acc["all"])
    return F.when(root.isNotNull(), values)


def _integral(t: Column, v: Column) -> Column:
    """Integers within 64 bits are BIGINT; a smaller DECIMAL without places was written as ``1.0``."""
    whole = F.try_variant_get(v, "$", "decimal(38,0)")
    small = whole.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    return (t == "BIGINT") | (t.startswith("DECIMAL") & t.endswith(",0)") & ~small)


def _matches(v: Column, needle) -> Column:
    """True where ``needle`` matches the value ``v`` itself: objects by sub-object, arrays
    order-free by element, scalars by type and value (integers and reals differ)."""
    t = F.schema_of_variant(v)
    if isinstance(needle, dict):
        members = F.try_variant_get(v, "$", "map<string,variant>")
        tests = [members.isNotNull()]
        for k, n in needle.items():
            member = F.try_element_at(members, F.lit(k))
            tests += [member.isNotNull(), _matches(member, n)]
    elif isinstance(needle, list):
        elements = F.try_variant_get(v, "$", "array<variant>")
        tests = [elements.isNotNull(), *[F.exists(elements, _matcher(n)) for n in needle]]
    elif needle is None:
        tests = [t == "VOID"]
    elif isinstance(needle, bool):
        tests = [t == "BOOLEAN", F.try_variant_get(v, "$", "boolean") == F.lit(needle)]
    elif isinstance(needle, str):
        tests = [t == "STRING", F.try_variant_get(v, "$", "string") == F.lit(needle)]
    elif isinstance(needle, int) and -(1 << 63) <= needle < 1 << 64:
        tests = [_integral(t, v), F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(str(needle)).cast("decimal(38,0)")]
    else:  # a real; integers beyond 64 bits are compared as such
        whole = F.try_variant_get(v, "$", "decimal(38,0)")
        beyond = (whole < F.lit(str(-(1 << 63))).cast("decimal(38,0)")) | (whole >= F.lit(str(1 << 64)).cast("decimal(38,0)"))
        tests = [(t == "DOUBLE") | (t == "FLOAT") | (t.startswith("DECIMAL") & ~_integral(t, v)) | (_integral(t, v) & beyond),
                 F.try_variant_get(v, "$", "double") == F.lit(float(needle))]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _matcher(needle):
    return lambda v: _matches(v, needle)


def _strings(n) -> set[str]:
    """JSON texts of the strings (keys and string values) a needle is made of."""
    if isinstance(n, dict):
        return {_json.dumps(k, ensure_ascii=False) for k in n}.union(*[_strings(v) for v in n.values()])
    if isinstance(n, list):
        return set().union(*[_strings(v) for v in n])
    return {_json.dumps(n, ensure_ascii=False)} if isinstance(n, str) else set()


def _may_contain(c: Column, needle) -> Column:
    """Necessary condition on the raw text: every quoted string of the needle occurs in it. A
    text with a backslash may write a string otherwise, so it always passes."""
    found = [F.contains(c, F.lit(t)) for t in sorted(_strings(needle))]
    return F.contains(c, F.lit("\\")) | reduce(lambda a, b: a & b, found) if found else F.lit(True)


def json_contains_many(col, needles_json: list[str]) -> Column:
    """``json_contains`` for several constant needles with one walk through each haystack:
    an ``array<boolean>`` in the order of ``needles_json``. Only texts that have all quoted
    strings of some needle are walked. NULL for NULL text; for a malformed one (also an
    object with a repeated key) an array of NULLs."""
    needles = [_json.loads(n) for n in needles_json]
    c = _c(col)
    may = reduce(lambda a, b: a | b, [_may_contain(c, n) for n in needles])
    none = F.array(*[F.lit(False)] * len(needles))
    found = F.aggregate(_all_values(c), none, lambda acc, v: F.array(*[acc[i] | _matches(v, n) for i, n in enumerate(needles)]))
    return (F.when(c.isNull(), F.lit(None))
            .when(F.try_parse_json(c).isNull(), F.array(*[F.lit(None).cast("boolean")] * len(needles)))
            .when(may, found).otherwise(none))


def json_contains(col, needle_json: str) -> Column:
    """``json_contains(haystack, needle)`` for a constant needle (JSON text; a string needle
    is written with its quotes)."""
    return json_contains_many(col, [needle_json])[0]
