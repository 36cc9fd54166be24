"""JSON functions against DuckDB on the edge-value document (JSON null vs missing vs
non-array, type names, malformed text, NULL)."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trafficlens.functions import json as J

DOC = ('{"a":null,"s":"x","n":1,"neg":-2,"d":1.5,"e":1e3,"b":true,'
       '"items":[{"id":1},{"id":2}],"emp":[],"o":{"k":[1]}}')
PATHS = ["$.a", "$.s", "$.n", "$.neg", "$.d", "$.b", "$.items", "$.emp", "$.o", "$.missing",
         "$.items[0]", "$.o.k"]


@pytest.fixture(scope="module")
def doc_df(spark):
    return spark.createDataFrame([(1, DOC), (2, None)], "id int, j string")


def duck(expr, text):
    con = duckdb.connect()
    return con.execute(f"SELECT {expr} FROM (SELECT ?::VARCHAR AS j)", [text]).fetchone()[0]


def spark_val(df, col, i=1):
    return df.filter(F.col("id") == i).select(col.alias("v")).collect()[0].v


@pytest.mark.parametrize("path", PATHS)
def test_exists_type_length_keys(doc_df, path):
    assert spark_val(doc_df, J.json_exists("j", path)) == duck(f"json_exists(j, '{path}')", DOC)
    assert spark_val(doc_df, J.json_type("j", path)) == duck(f"json_type(j, '{path}')", DOC)
    assert spark_val(doc_df, J.json_array_length("j", path)) == \
        duck(f"json_array_length(j, '{path}')", DOC)
    assert spark_val(doc_df, J.json_keys("j", path)) == duck(f"json_keys(j, '{path}')", DOC)


@pytest.mark.parametrize("path", ["$.a", "$.s", "$.n", "$.b", "$.items", "$.o", "$.missing"])
def test_extract_and_value(doc_df, path):
    assert spark_val(doc_df, J.json_extract_string("j", path)) == duck(f"j ->> '{path}'", DOC)
    assert spark_val(doc_df, J.json_value("j", path)) == \
        duck(f"CAST(json_value(j, '{path}') AS VARCHAR)", DOC)
    assert spark_val(doc_df, J.json_extract("j", path)) == duck(f"CAST(j -> '{path}' AS VARCHAR)", DOC)


def test_last_and_wildcard(doc_df):
    assert spark_val(doc_df, J.json_last("j", "$.items")) == duck("j ->> '$.items[#-1]'", DOC)
    assert spark_val(doc_df, J.json_last("j", "$.emp")) == duck("j ->> '$.emp[#-1]'", DOC)
    assert spark_val(doc_df, J.json_all("j", "$.items", "id")) == duck("j ->> '$.items[*].id'", DOC)
    assert spark_val(doc_df, J.json_all("j", "$.emp")) == duck("j ->> '$.emp[*]'", DOC)


@pytest.mark.parametrize("path", ["$.items[#-1]", "$.items[#-1].id", "$.items[*]", "$.items[*].id", "$.emp[*]", "$.emp[#-1]", "$.o.k[*]", "$.missing[*]", "$.s[*]"])
def test_steps_in_ordinary_paths(doc_df, path):
    assert spark_val(doc_df, J.json_extract_string("j", path)) == duck(f"j ->> '{path}'", DOC)
    kind = "VARCHAR[]" if "*" in path else "VARCHAR"
    assert spark_val(doc_df, J.json_extract("j", path)) == duck(f"CAST(j -> '{path}' AS {kind})", DOC)
    assert spark_val(doc_df, J.json_extract_string("j", path), 2) is None
    assert spark_val(doc_df, J.json_extract("j", path), 2) is None


def test_path_lists(doc_df):
    assert spark_val(doc_df, J.json_extract_many("j", ["$.s", "$.n"])) == duck("j ->> ['$.s', '$.n']", DOC)
    assert spark_val(doc_df, J.json_extract_many("j", ["$.s", "$.n"], quoted=True)) == duck("CAST(j -> ['$.s', '$.n'] AS VARCHAR[])", DOC)


def test_null_input(doc_df):
    assert spark_val(doc_df, J.json_exists("j", "$.s"), 2) is None
    assert spark_val(doc_df, J.json_type("j", "$.s"), 2) is None


@pytest.mark.parametrize("needle", ['{"id":2}', '[{"id":1}]', '"x"', '1', '{"k":[1]}',
                                    '{"o":{"k":[1]}}', '"xy"', '[3,1]', 'true', '{"id":3}'])
def test_json_contains(doc_df, needle):
    hay = DOC if needle != "[3,1]" else "[1,2,3]"
    df = doc_df.sparkSession.createDataFrame([(1, hay)], "id int, j string")
    assert spark_val(df, J.json_contains("j", needle)) == \
        duck(f"json_contains(j, '{needle}')", hay)


def test_json_each(doc_df):
    rows = J.json_each(doc_df.filter("id = 1"), "j", "$.items").select("item.*").collect()
    assert [(r.key, r.type) for r in rows] == [("0", "OBJECT"), ("1", "OBJECT")]
    assert [J._json.loads(r.value)["id"] for r in rows] == [1, 2]


NUM_DOC = ('{"d":1.5,"e":1e3,"neg":-2,"big":12345678901234567890,"f":0.1,'
           '"s":"a\\"b","u":"\\u00e9","z":0,"one":1.0}')


@pytest.mark.parametrize("path", ["$.d", "$.e", "$.neg", "$.big", "$.f", "$.s", "$.u", "$.z"])
def test_numbers_and_escapes(spark, path):
    df = spark.createDataFrame([(1, NUM_DOC)], "id int, j string")
    assert spark_val(df, J.json_type("j", path)) == duck(f"json_type(j, '{path}')", NUM_DOC)
    assert spark_val(df, J.json_extract("j", path)) == duck(f"CAST(j -> '{path}' AS VARCHAR)", NUM_DOC)
    assert spark_val(df, J.json_value("j", path)) == \
        duck(f"CAST(json_value(j, '{path}') AS VARCHAR)", NUM_DOC)
    assert spark_val(df, J.json_extract_string("j", path)) == duck(f"j ->> '{path}'", NUM_DOC)


def test_json_each_keeps_document_key_order(spark):
    doc = '{"items":[{"b":1,"a":[2,{"y":1,"x":2}]},"s",3,null,[1,"t"]],"o":{"q":{"d":1,"c":2},"p":"v"}}'
    df = spark.createDataFrame([(1, doc)], "id int, j string")
    for path in ["$.items", "$.o"]:
        got = [(r.key, r.value, r.type) for r in
               J.json_each(df, "j", path).select("item.*").collect()]
        con = duckdb.connect()
        exp = [(str(k), str(v) if v is not None else None, t) for k, v, t in con.execute(
            f"SELECT key, CAST(value AS VARCHAR), type FROM json_each(?::JSON, '{path}')",
            [doc]).fetchall()]
        assert got == exp, path


def contains_both(spark, texts, needles):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {r.id: r.v for r in df.select("id", J.json_contains_many("j", needles).alias("v")).collect()}
    con = duckdb.connect()
    for i, t in enumerate(texts):
        assert got[i] == [con.execute("SELECT json_contains(?, ?)", [t, n]).fetchone()[0] for n in needles], (t, needles)


def test_contains_against_duckdb(spark):
    texts = ['{"ok":1}', '{"a":"ok"}', '["x","ok"]', '{"a":"b","ok":"c"}', '{"a" : "ok" , "k" : [ ]}', '{"k":{"k":[1]}}', '{"a":"say \\"ok\\""}', '{"a":"o\\u006b"}', '"ok"', '{"k":"[]"}', '[", "]', '["a", "b"]', '{"k":{}}',
             '{"a":true,"b":1}', '["foo", 1, "bar"]', '[1.0]', '[1e0]', '[-1,0.1]', '[18446744073709551615]', '[[1,2],[[3]]]', '[null]', '[]', '{}', '[{"a":1},{"b":2}]', '7', '{"a":{"b":{"c":[{"d":null}]}}}', '[123456789012345678901234567890]', '["\\\\"]']
    needles = ['"ok"', '{"k":[]}', '{"k":{}}', '{"a":"ok"}', '", "', '1', '{"a":"ok","k":[]}', '":true,"', '", 1, "', '1.0', '-1', '0.1', '18446744073709551615', '[2,1]', '[[3]]', 'null', '[]', '{}', 'true', '{"a":1,"b":2}', '7', '{"d":null}',
               '123456789012345678901234567890', '"\\\\"', '":"', '","', '"]"', '"["', '"true"', '"null"']
    contains_both(spark, texts, needles)
    df = spark.createDataFrame([(1, None), (2, "{bad")], "id int, j string")
    assert [r.v for r in df.select(J.json_contains_many("j", needles[:2]).alias("v")).collect()] == [None, [None, None]]


def test_contains_has_no_python(spark):
    df = spark.createDataFrame([(1, "{}")], "id int, j string").select(J.json_contains("j", '{"a":[1,{"b":"c"}]}'))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


_WORDS = st.sampled_from([":", ",", "[", "]", "{", "}", "true", "null", "1", " ", '"', "\\", "a", "ok", ":true,", '","', "é", "\n"])
_SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.5, 1.5, 2.25, 1e300]), st.lists(_WORDS, max_size=3).map("".join))
_VALUES = st.recursive(_SCALARS, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.lists(_WORDS, min_size=1, max_size=2).map("".join), x, max_size=3)), max_leaves=8)


def parts_of(v):
    yield v
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        yield from parts_of(x)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_VALUES, min_size=8, max_size=8), st.lists(_VALUES, min_size=2, max_size=2), st.randoms(use_true_random=False))
def test_contains_property(spark, values, more, rng):
    """Generated documents; needles are parts of them, rearranged, and others."""
    needles = []
    for v in values[:4]:
        n = rng.choice(list(parts_of(v)))
        needles.append(dict(rng.sample(sorted(n.items()), k=len(n) // 2 + 1)) if isinstance(n, dict) and n else rng.sample(n, k=(len(n) + 1) // 2) if isinstance(n, list) else n)
    texts = [J._json.dumps(v, ensure_ascii=rng.random() < 0.5) for v in values]
    contains_both(spark, texts, [J._json.dumps(n, ensure_ascii=False) for n in needles + more])
