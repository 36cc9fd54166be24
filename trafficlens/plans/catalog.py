"""Query catalog: every registered query has a Spark builder ``fn(spark, sf_dir)`` and,
where SQL can express it exactly, the DuckDB oracle text over the raw tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trafficlens.sources.testtables import ntz, oracle_with, register_views

# Fixed scope of the catalog queries: the test data covers January 2024 (UTC).
SINCE = "2024-01-01T00:00:00Z"
UNTIL = "2024-01-31T00:00:00Z"
NOW = "2024-01-31T00:00:00Z"


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(v) -> DataFrame`` where ``v`` is the dict of telemetry views."""

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return ntz(fn(register_views(spark, sf_dir)))

        REGISTRY[name] = Query(name, build, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco


def W(*views: str) -> str:
    """Oracle ``WITH`` prefix for the named telemetry views."""
    return oracle_with(*views)


def load_all():
    """Import every plan module so that its queries register."""
    from trafficlens.plans import (  # noqa: F401
        json_queries, log_queries, metrics_queries, patterns, store_queries)
    return REGISTRY
