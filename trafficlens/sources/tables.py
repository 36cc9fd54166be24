"""Tables of telemetry as partitioned Parquet, replaced partition by partition by Spark's writer.

Layout::

    <root>/<table>/app_id=<a>/_date=<d>/     dated tables; the others by app_id alone
    <root>/_keys/<table>/app_id=<a>/bucket=<b>/   where a key's rows may lie: (key, date)
    <root>/_pending/<table>/<batch>/         new content of the partitions a write touches

A refetch reads the partitions it touches, writes their whole new content as a pending table
(which cuts the lineage) and overwrites just these partitions from there
(``partitionOverwriteMode=dynamic``). A partition that loses all its rows keeps one row marked
as not live, so that the overwrite reaches it; reads leave such rows out. If a write fails half
way, the same batch applied again finds its pending table and only repeats the overwrite. One
writer per app and table at a time (a landing stream is one).

Rows are range-partitioned and sorted by time before writing: few files, and row-group
statistics that skip within a date. Reads prune partitions by app and date. The key table is
bucketed, so that a small refetch finds the dates of its keys by opening their buckets only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.timerange import in_range, resolve_instant
from trafficlens.schemas import TABLES
from trafficlens.sources.sql import require_scope, run_sql

# Time column each table is scoped and dated by; the other tables are kept by app alone.
TIME_COLUMN = {"request_logs": "timestamp", "application_logs": "timestamp",
               "metrics": "period_start", "spans": "start_time_ns"}
# Column whose dates the key table remembers (one refetch replaces all rows of a request).
KEY_COLUMN = {t: "request_uuid" for t in ("request_logs", "application_logs", "spans")}
BUCKETS = 256


def date_of(table: str) -> Column:
    """The UTC date a row is filed under."""
    c = F.col(TIME_COLUMN[table])
    if table == "spans":
        c = F.timestamp_micros(F.floor(c / 1000).cast("bigint"))
    return F.date_format(c, "yyyy-MM-dd")


def _ids(app_id) -> list[int]:
    return [int(a) for a in (app_id if isinstance(app_id, (list, tuple, set)) else [app_id])]


class TableStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # -- files ----------------------------------------------------------------------
    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        p, fs = self._path(name)
        return fs.exists(p)

    def _delete(self, name: str) -> None:
        p, fs = self._path(name)
        fs.delete(p, True)

    def tables(self) -> list[str]:
        """Names of all tables in the store, also those the user made."""
        p, fs = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if not n.startswith("_"))

    # -- read -------------------------------------------------------------------------
    def _parts(self, table: str) -> list[str]:
        return ["app_id", "_date"] if table in TIME_COLUMN else ["app_id"]

    def _stored(self, table: str) -> DataFrame:
        """All stored rows, with their partition and ``_live``; empty when there is no table."""
        schema = T.StructType([*TABLES[table].fields, T.StructField("_live", T.BooleanType()),
                               *([T.StructField("_date", T.StringType())] if table in TIME_COLUMN else [])])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, table: str, app_id=None, since=None, until=None) -> DataFrame:
        """The table's rows, of all apps or of the given app ids. ``since``/``until`` scope its
        time column: only the partitions of those dates are opened, and the bounds reach the
        Parquet scan. A canonical table without rows is an empty frame."""
        if table not in TABLES:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{table}")
        df = self._stored(table).filter("_live")
        if app_id is not None:
            df = df.filter(F.col("app_id").isin(*_ids(app_id)))
        if table in TIME_COLUMN:
            if since is not None:
                df = df.filter(F.col("_date") >= resolve_instant(since).strftime("%Y-%m-%d"))
            if until is not None:
                last = resolve_instant(until) - timedelta(microseconds=1)
                df = df.filter(F.col("_date") <= last.strftime("%Y-%m-%d"))
            t = F.col(TIME_COLUMN[table])
            if table == "spans":
                ns = [None if x is None else int(resolve_instant(x).timestamp() * 1_000_000) * 1000 for x in (since, until)]
                df = df if ns[0] is None else df.filter(t >= F.lit(ns[0]))
                df = df if ns[1] is None else df.filter(t < F.lit(ns[1]))
            else:
                df = df.filter(in_range(t, since, until))
        return df.select(*TABLES[table].fieldNames())

    def scoped(self, table: str, app_id, since, until=None) -> DataFrame:
        """The read a query over a dated table starts from: which apps and from when are
        mandatory, so no query opens a table's whole history by omission."""
        if app_id is None or since is None:
            raise ValueError(f"{table} is read by app_id and since")
        if table not in TIME_COLUMN:
            raise ValueError(f"{table} has no time column")
        return self.read(table, app_id, since, until)

    # -- write ------------------------------------------------------------------------
    def write(self, table: str, df: DataFrame, apps=None) -> None:
        """``df`` as the whole content of each app it holds rows for, and of each app in
        ``apps``, also when it has none for it. A table that is not canonical is replaced whole."""
        if table not in TABLES:
            df.write.mode("overwrite").parquet(f"{self.root}/{table}")
            return
        held = df.select("app_id").distinct()
        if apps:
            held = held.unionByName(self.spark.createDataFrame([(int(a),) for a in apps], "app_id int")).distinct()
        old = self._stored(table).join(held, "app_id", "left_semi")
        if table in KEY_COLUMN:
            self._remember(table, df)
        self._replace(table, old, df, None, F.lit(True))

    def replace(self, table: str, app_id: int, fn: Callable[[DataFrame], DataFrame],
                dates: tuple[str, str] | tuple = (), batch: str | None = None) -> None:
        """``fn(current)`` in place of the app's rows of the dates from ``dates[0]`` to
        ``dates[1]``; nothing when ``dates`` is empty. ``fn``'s rows must be of these dates."""
        if not dates or self._resumed(table, batch):
            return
        within = F.col("_date").between(*dates)
        old = self._stored(table).filter((F.col("app_id") == app_id) & within)
        self._replace(table, old, fn(self._live(table, old)), batch, (F.col("app_id") == app_id) & within)

    def merge(self, table: str, app_id: int, staged: DataFrame, keys: list[str],
              fn: Callable[[DataFrame, DataFrame], DataFrame], matched: DataFrame | None = None,
              batch: str | None = None) -> None:
        """``fn(current, staged)`` over the partitions that ``staged`` touches: those of its own
        rows, and those where the key table has a key of ``matched`` (default ``staged``).
        Other partitions are not opened."""
        if self._resumed(table, batch):
            return
        mine = F.col("app_id") == app_id
        if table in TIME_COLUMN:
            days = staged.select(date_of(table).alias("d")).distinct()
            if table in KEY_COLUMN:
                self._remember(table, staged, app_id)
                days = days.unionByName(self._dates_of(table, app_id, staged if matched is None else matched)).distinct()
            touched = [r["d"] for r in days.collect()]  # one row per date
            mine = mine & F.col("_date").isin(*touched)
        old = self._stored(table).filter(mine)
        self._replace(table, old, fn(self._live(table, old), staged), batch, mine)

    def _live(self, table: str, stored: DataFrame) -> DataFrame:
        return stored.filter("_live").select(*TABLES[table].fieldNames())

    def _replace(self, table: str, old: DataFrame, new: DataFrame, batch: str | None, allowed: Column) -> None:
        """The partitions of ``old`` and ``new`` hold ``new``'s rows; all must be ``allowed``."""
        from trafficlens.operators.store import align

        parts = self._parts(table)
        rows = align(new, table).withColumn("_live", F.lit(True))
        if table in TIME_COLUMN:
            rows = rows.withColumn("_date", date_of(table))
        emptied = old.select(*parts).distinct().withColumn("_live", F.lit(False))
        batch = batch or uuid.uuid4().hex
        pending = f"{self.root}/_pending/{table}/{batch}"
        rows.unionByName(emptied, allowMissingColumns=True).write.mode("overwrite").parquet(pending)
        if not self.spark.read.schema(rows.schema).parquet(pending).filter(~F.coalesce(allowed, F.lit(False))).isEmpty():
            self._delete(f"_pending/{table}/{batch}")
            raise ValueError("rows of partitions that were not read")
        self._apply(table, batch)

    def _apply(self, table: str, batch: str) -> None:
        """Overwrite the partitions that a pending table holds, then drop it."""
        parts = self._parts(table)
        pending = f"{self.root}/_pending/{table}/{batch}"
        schema = T.StructType([*TABLES[table].fields, T.StructField("_live", T.BooleanType()),
                               *([T.StructField("_date", T.StringType())] if table in TIME_COLUMN else [])])
        rows = self.spark.read.schema(schema).parquet(pending)
        by = [*parts, *([TIME_COLUMN[table]] if table in TIME_COLUMN else [])]
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.root}/{table}")
        self._delete(f"_pending/{table}/{batch}")

    def _resumed(self, table: str, batch: str | None) -> bool:
        """Finish the batch if its pending table was written whole before."""
        if batch is None or not self._exists(f"_pending/{table}/{batch}/_SUCCESS"):
            return False
        self._apply(table, batch)
        return True

    # -- key table ----------------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _known(self, table: str, app_ids: Column, of: DataFrame) -> DataFrame:
        """The key table's rows in the buckets of the keys in ``of``."""
        schema = "key string, date string, app_id int, bucket int"
        try:
            known = self.spark.read.schema(schema).parquet(f"{self.root}/_keys/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        buckets = [r["bucket"] for r in of.select(self._bucket().alias("bucket")).distinct().collect()]  # at most self.buckets
        return known.filter(app_ids & F.col("bucket").isin(*buckets))

    def _remember(self, table: str, rows: DataFrame, app_id: int | None = None) -> None:
        """Add the (key, date) pairs of ``rows`` that the key table lacks. Pairs of rows that have
        moved since stay: they only cost the opening of a date."""
        app = F.col("app_id") if app_id is None else F.lit(app_id)
        pairs = rows.select(F.col(KEY_COLUMN[table]).alias("key"), date_of(table).alias("date"), app.cast("int").alias("app_id")).distinct()
        known = self._known(table, F.lit(True) if app_id is None else F.col("app_id") == app_id, pairs)
        new = pairs.join(known.drop("bucket"), ["app_id", "key", "date"], "left_anti").withColumn("bucket", self._bucket())
        new.repartition("app_id", "bucket").write.mode("append").partitionBy("app_id", "bucket").parquet(f"{self.root}/_keys/{table}")

    def _dates_of(self, table: str, app_id: int, keyed: DataFrame) -> DataFrame:
        keys = keyed.select(F.col(KEY_COLUMN[table]).alias("key")).distinct()
        return self._known(table, F.col("app_id") == app_id, keys).join(keys, "key", "left_semi").select(F.col("date").alias("d")).distinct()

    def compact_keys(self, table: str, app_id: int) -> None:
        """Upkeep: the app's key buckets in one file each, for many small refetches leave many."""
        path = f"{self.root}/_keys/{table}"
        known = self.spark.read.schema("key string, date string, app_id int, bucket int").parquet(path).filter(F.col("app_id") == app_id)
        pending = f"{self.root}/_pending/_keys/{table}-{app_id}"
        known.distinct().write.mode("overwrite").parquet(pending)
        self.spark.read.parquet(pending).repartition("app_id", "bucket").write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("app_id", "bucket").parquet(path)
        self._delete(f"_pending/_keys/{table}-{app_id}")

    def span_of(self, table: str, staged: DataFrame) -> tuple:
        """First and last date of ``staged``, for ``replace``; empty without rows. Metrics
        periods can end a day after they start, so the last date is that of their end."""
        d = staged.withColumn("_d", date_of(table))
        last = F.date_format("period_end", "yyyy-MM-dd") if table == "metrics" else F.col("_d")
        lo, hi = d.agg(F.min("_d"), F.max(last)).first()
        return () if lo is None else (lo, hi)

    def sql(self, text: str) -> DataFrame:
        """Free SQL over the store's tables. A query over a dated table must say which apps and
        which time it is about, also in its subqueries and joins: one that does not is refused
        (``Unscoped``) before it runs."""
        self.register()
        return require_scope(run_sql(self.spark, text), self._path("")[0].toUri().getPath().rstrip("/"), TIME_COLUMN)

    # -- upkeep -----------------------------------------------------------------------
    def register(self) -> dict[str, DataFrame]:
        """Register every table as a temp view."""
        out = {t: self.read(t) for t in sorted(set(self.tables()) | set(TABLES))}
        for t, df in out.items():
            df.createOrReplaceTempView(t)
        return out

    def reset(self) -> None:
        """Drop every table in the store (also ones the user made); the eight canonical
        tables then read as empty."""
        for t in [*self.tables(), "_keys", "_pending"]:
            self._delete(t)
