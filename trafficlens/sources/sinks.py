"""Sinks: NDJSON with explicit nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ndjson_line(df: DataFrame) -> Column:
    """One JSON object per row; NULL fields are written as ``null``, not dropped."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                     {"ignoreNullFields": "false"})


def ndjson_text(df: DataFrame) -> DataFrame:
    return df.select(ndjson_line(df).alias("line"))


def write_ndjson(df: DataFrame, path: str, mode: str = "error") -> None:
    """NDJSON files, one object per line, every column present in every line."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
