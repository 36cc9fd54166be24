"""The registered queries: names, result columns, and their SQL where they have some."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op2_topk_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op3_quality_crf": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_token_output": {"slot": "bigint", "shard": "bigint", "doc_ids": "array<bigint>", "sha256": "string"},
    "op7_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "distance": "bigint"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op12_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


def test_all_are_registered():
    assert {n for n in E.queries() if n.startswith("op")} == set(COLUMNS)
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_sql(spark, name):
    df = E.queries()[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in ("op1_substring_dedup", "op3_quality_crf", "op4_mix_sources", "op5_suffix_dedup", "op9_language_id", "op10_jaccard_join", "op11_merkle_manifest", "op13_bpe"):
        assert len(rows) == documents
    if name in E.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        want = con.execute(E.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want.fetchall())


def test_guard_without_the_subpackage(spark, tmp_path):
    """The entry still imports, with the other queries, when the llm folders are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(f"{root}/trafficlens", tmp_path / "trafficlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(x for x in e.queries() if not x.startswith('q_')), len(e.queries()) > 100)"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert said.stdout.strip() == "[] True", said.stderr
