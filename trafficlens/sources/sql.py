"""Free SQL over the registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(tables: dict[str, DataFrame]) -> None:
    """Register each DataFrame under its table name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Run one SQL statement (Spark dialect). An unknown table raises an analysis error;
    a query matching nothing returns zero rows."""
    text = text.strip().rstrip(";")
    if not text:
        raise ValueError("empty SQL text")
    return spark.sql(text)


class Unscoped(ValueError):
    """A query would read a dated table of the store without an app or a time range."""


def _scans(df: DataFrame) -> list:
    """The file scans of a query and of the subqueries that its optimised plan still has."""
    execution, session = df._jdf.queryExecution(), df._jdf.sparkSession()
    of_plan = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    subqueries = execution.optimizedPlan().subqueriesAll()
    plans = [execution.sparkPlan(), *[of_plan(session, subqueries.apply(i)).queryExecution().sparkPlan() for i in range(subqueries.size())]]
    leaves = [p.collectLeaves() for p in plans]
    return [x for found in leaves for i in range(found.size()) if (x := found.apply(i)).nodeName().startswith("Scan parquet")]


def _compares(filters, column: str) -> bool:
    """Is one of a scan's filters a comparison of the column (more than that it is not NULL)?"""
    texts = [filters.apply(i).toString() for i in range(filters.size())]
    return any(f"{column}#" in t and "isnotnull(" not in t and "isnull(" not in t for t in texts)


def require_scope(df: DataFrame, root: str, time_columns: dict[str, str]) -> DataFrame:
    """``df``, if every scan of a dated table below ``root`` is pruned to apps and bounded in
    time, as the planned query shows: a filter on app_id reaches the table's partitions and one on
    its time column (``time_columns``) the scan. Else Unscoped."""
    for scan in _scans(df):
        paths = scan.relation().location().rootPaths()
        for i in range(paths.size()):
            path = paths.apply(i).toUri().getPath()
            table = path.rpartition("/")[2]
            if table not in time_columns or path.rpartition("/")[0] != root:
                continue
            if not _compares(scan.partitionFilters(), "app_id"):
                raise Unscoped(f"{table} is read without an app_id filter")
            if not _compares(scan.dataFilters(), time_columns[table]):
                raise Unscoped(f"{table} is read without a filter on {time_columns[table]}")
    return df
