"""Corpus pipeline over ``documents``: identify the language, keep one document of each near-duplicate
group, drop documents that hold benchmark items, mix the sources, write shuffled token shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; between
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficlens.llm.decontaminate import remove_leaks
from trafficlens.llm.jaccard_join import keep_one_of_each
from trafficlens.llm.language_id import keep_identified
from trafficlens.llm.mixing import apply_mix
from trafficlens.llm.token_output import materialize, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity (0.8 of the distinct five-word runs), the document of smallest doc_id stays."""
    return keep_one_of_each(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken 0, 1 or 2 times, so that every source comes near its target."""
    return apply_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length token sequences in shuffled, fixed-stride shards; a row for each sequence."""
    return materialize(docs, shared_folder(spark, "pipeline-shards"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_output", token_output)]

#: the stages learn, draw and hash: SQL cannot express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
