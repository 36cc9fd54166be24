import json

import pytest
from pyspark.errors import AnalysisException

from trafficlens.sources.sinks import ndjson_text
from trafficlens.sources.sql import run_sql


def test_sql_rows_nulls_and_empty(spark):
    spark.createDataFrame([(1, "hello"), (2, None)], "id int, name string") \
        .createOrReplaceTempView("test")
    df = run_sql(spark, "SELECT * FROM test ORDER BY id")
    lines = [json.loads(r.line) for r in ndjson_text(df).collect()]
    assert lines == [{"id": 1, "name": "hello"}, {"id": 2, "name": None}]
    assert run_sql(spark, "SELECT * FROM test WHERE id > 5").count() == 0


def test_sql_unknown_table(spark):
    with pytest.raises(AnalysisException):
        run_sql(spark, "SELECT * FROM no_such_table")
