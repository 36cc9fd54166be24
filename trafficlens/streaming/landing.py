"""Incremental landing of landed files with Structured Streaming.

Request logs (upsert) and metrics (range replace), as NDJSON or as Arrow streams, and
request-details documents (upsert + children replace) each have a landing stream.

New files in the landing folder are read as a stream with the wire schema; malformed input
stops the stream. Of Arrow files Spark's file source streams the names only, so its log of
files seen serves them too, and each batch reads its files' headers for the columns. A file
whose time lies a week or more before that of the newest one seen is not picked up (the source's
``maxFileAge``): move files in with the time of their landing. A micro-batch may hold several fetches (files): rows carry their file's
modification time and path, and the outcome is that of landing the files one after the
other, so of several values for a key the newest fetch's stays, each metrics fetch replaces
its own time range only, and a file delivered twice changes nothing. Only the app's dates
that the batch touches are rewritten. Replaying a batch after a failure (Spark re-runs an epoch
whose commit was not recorded) yields the same table: what the failed run had prepared is
applied, or the batch is computed again from tables that may hold it already. Progress lives in
the checkpoint under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficlens.operators.store import (align, dedup, range_replace_fetches, replace_children,
                                         upsert)
from trafficlens.session import checkpoint_dir
from trafficlens.sources.arrow_stream import REQUIRED, decode, table_rows
from trafficlens.sources.pages import (METRICS_WIRE, REQUEST_DETAILS, REQUEST_LOG_WIRE,
                                       details_frames, logs_from_wire, require, ts)
from trafficlens.sources.tables import TableStore

# Which fetch a row came with: later files win, and later rows of one file.
NEWEST = ("_modified", "_file", "_row")


def _stream(spark: SparkSession, schema, landing_dir: str, multiline: bool = False) -> DataFrame:
    return (spark.readStream.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST")
            .json(landing_dir)
            .select("*", F.col("_metadata.file_modification_time").alias("_modified"),
                    F.col("_metadata.file_path").alias("_file")))


def _arrow_files(spark: SparkSession, landing_dir: str) -> DataFrame:
    """New Arrow files as (path, modificationTime); contents are not read here."""
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .load(landing_dir).select("path", "modificationTime"))


def _start(spark, stream, batch, name, checkpoint, available_now) -> StreamingQuery:
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/landing/{name}"
    run = hashlib.sha256(ckpt.encode()).hexdigest()[:16]  # names a batch the same way when it is replayed
    w = stream.writeStream.foreachBatch(lambda df, epoch: batch(df, f"{run}-{epoch}")).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def land_request_logs(spark: SparkSession, landing_dir: str, store: TableStore,
                      app_id: int, name: str = "request_logs",
                      checkpoint: str | None = None,
                      available_now: bool = True, arrow: bool = False) -> StreamingQuery:
    """Start the landing stream; with ``available_now`` it processes what is there and
    stops (call ``awaitTermination``). The folder holds NDJSON, or with ``arrow`` Arrow streams."""

    def batch(df: DataFrame, run: str) -> None:
        if arrow:
            staged = table_rows(decode(df), "request_logs", app_id, REQUIRED["request_logs"], keep=NEWEST)
        else:
            rows = df.withColumn("_row", F.monotonically_increasing_id())
            staged = require(logs_from_wire(rows, app_id, keep=NEWEST), *REQUIRED["request_logs"])
        store.merge("request_logs", app_id, staged, ["app_id", "request_uuid"],
                    lambda current, new: upsert(current, new, table="request_logs", newest=NEWEST), batch=run)

    stream = _arrow_files(spark, landing_dir) if arrow else _stream(spark, REQUEST_LOG_WIRE, landing_dir)
    return _start(spark, stream, batch, name, checkpoint, available_now)


def land_metrics(spark: SparkSession, landing_dir: str, store: TableStore, app_id: int,
                 name: str = "metrics", checkpoint: str | None = None,
                 available_now: bool = True, arrow: bool = False) -> StreamingQuery:
    """Metrics files (NDJSON, or with ``arrow`` Arrow streams) -> range replace of the app's
    metrics, fetch by fetch."""

    def batch(df: DataFrame, run: str) -> None:
        fetch = ("_modified", "_file")
        if arrow:
            staged = table_rows(decode(df), "metrics", app_id, REQUIRED["metrics"], keep=fetch)
        else:
            raw = df.withColumn("period_start", ts("period_start")) \
                .withColumn("period_end", ts("period_end"))
            staged = require(align(raw, "metrics", app_id, keep=fetch), *REQUIRED["metrics"])
        store.replace("metrics", app_id, lambda current: range_replace_fetches(
            current, staged, "_file", ("_modified",)), dates=store.span_of("metrics", staged), batch=run)

    stream = _arrow_files(spark, landing_dir) if arrow else _stream(spark, METRICS_WIRE, landing_dir)
    return _start(spark, stream, batch, name, checkpoint, available_now)


def land_request_details(spark: SparkSession, landing_dir: str, store: TableStore,
                         app_id: int, name: str = "request_details",
                         checkpoint: str | None = None,
                         available_now: bool = True) -> StreamingQuery:
    """Request-details documents -> upsert of the requests, children replace of their
    application logs and spans (a request refetched without logs loses its old ones). Of
    several documents of one request the newest counts, before its children are read."""

    def batch(df: DataFrame, run: str) -> None:
        newest = dedup(df, ["request_uuid"], ("_modified", "_file")).drop("_modified", "_file")
        newest = newest.persist()  # one reading for the three tables
        try:
            req, logs, spans = details_frames(newest, app_id)
            parents = req.select("app_id", "request_uuid")
            store.merge("request_logs", app_id, req, ["app_id", "request_uuid"],
                        lambda current, new: upsert(current, new, table="request_logs"), batch=run)
            for table, children in (("application_logs", logs), ("spans", spans)):
                store.merge(table, app_id, align(children, table), ["app_id", "request_uuid"],
                            lambda current, new: replace_children(current, new, parents), matched=parents, batch=run)
        finally:
            newest.unpersist()

    return _start(spark, _stream(spark, REQUEST_DETAILS, landing_dir, multiline=True), batch, name, checkpoint, available_now)


def land_arrow_request_logs(spark: SparkSession, paths: list[str], store: TableStore, app_id: int) -> None:
    """One fetch of request logs as Arrow streams -> upsert."""
    from trafficlens.sources.arrow_stream import read_request_logs_arrow

    staged = read_request_logs_arrow(spark, paths, app_id)
    store.merge("request_logs", app_id, staged, ["app_id", "request_uuid"],
                lambda current, new: upsert(current, new, table="request_logs"))


def land_arrow_metrics(spark: SparkSession, paths: list[str], store: TableStore, app_id: int) -> None:
    """One fetch of metrics as Arrow streams -> range replace."""
    from trafficlens.operators.store import range_replace
    from trafficlens.sources.arrow_stream import read_metrics_arrow

    staged = read_metrics_arrow(spark, paths, app_id)
    store.replace("metrics", app_id, lambda current: range_replace(current, staged), dates=store.span_of("metrics", staged))


def land_pages(spark: SparkSession, store: TableStore, app_id: int, *, apps=None, consumers=None, endpoints=None) -> None:
    """Store landed apps, consumers and endpoints pages (paths): upsert on each table's key."""
    from trafficlens.schemas import TABLE_KEYS
    from trafficlens.sources.pages import read_apps, read_consumers, read_endpoints

    staged = {}
    if apps:
        staged["apps"], staged["app_envs"] = (x.filter(F.col("app_id") == app_id) for x in read_apps(spark, apps))
    if consumers:
        staged["consumers"] = read_consumers(spark, consumers, app_id)
    if endpoints:
        staged["endpoints"] = read_endpoints(spark, endpoints, app_id)
    for table, new in staged.items():
        store.merge(table, app_id, new, TABLE_KEYS[table], lambda current, n, table=table: upsert(current, n, table=table))
