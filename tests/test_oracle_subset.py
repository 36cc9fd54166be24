"""A sample of catalog queries against their DuckDB oracle at sf0.001 (the full set runs
with scripts/oracle_check.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
SAMPLE = ["q_error_investigation", "q_metrics_day", "q_metrics_tz_hour", "q_metrics_tz_day",
          "q_metrics_expected", "q_metrics_rollup_30m", "q_f_hdr_value_neg", "q_f_like_escape",
          "q_logs_sample_size", "q_logs_limit", "q_json_type", "q_jsonpath_all",
          "q_failed_items", "q_upsert_null_overwrite", "q_metrics_range_replace",
          "q_replace_children", "q_span_tree", "q_join_envs", "q_daily_counts_tz",
          "q_ndjson_rows"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]
