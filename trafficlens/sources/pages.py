"""Readers for landed API pages and NDJSON files.

Each reader is one parallel ``spark.read.json`` over every landed file with an explicit
schema (no inference pass), then ``explode`` of the ``data`` array and a projection to
the canonical table. Fields missing from a file become NULL; unknown fields are ignored.
ISO 8601 texts become timestamps. Nothing is dropped: malformed JSON, a text that is no
datetime, a page without its ``data`` and a row without a required value all raise an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.headers import reshape_lists
from trafficlens.operators.store import align
from trafficlens.schemas import METRICS

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _st(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


def _page(item: T.StructType, paged: bool = False) -> T.StructType:
    f = {"data": T.ArrayType(item)}
    if paged:
        f.update(has_more=T.BooleanType(), next_token=S)
    return _st(**f)


ENV_ITEM = _st(id=L, name=S, created_at=S, last_sync_at=S)
APP_ITEM = _st(id=L, name=S, framework=S, client_id=S, envs=T.ArrayType(ENV_ITEM), created_at=S)
CONSUMER_ITEM = _st(id=L, identifier=S, name=S, group=_st(id=L, name=S), created_at=S,
                    last_request_at=S)
ENDPOINT_ITEM = _st(id=L, method=S, path=S)
PAIRS = T.ArrayType(T.ArrayType(S))

# Metrics rows on the wire: every column optional except the period.
METRICS_WIRE = T.StructType([T.StructField(f.name, S if f.name.startswith("period_") else f.dataType)
                             for f in METRICS.fields if f.name != "app_id"])

REQUEST_LOG_WIRE = _st(timestamp=S, request_uuid=S, env=S, method=S, path=S, url=S,
                       consumer_id=L, request_headers=PAIRS, request_size_bytes=L,
                       request_body_json=S, status_code=I, response_time_ms=I,
                       response_headers=PAIRS, response_size_bytes=L, response_body_json=S,
                       client_ip=S, client_country_iso_code=S, exception_type=S,
                       exception_message=S, exception_stacktrace=S, sentry_event_id=S,
                       trace_id=S)

LOG_ITEM = _st(timestamp=S, message=S, level=S, logger=S, file=S, line=I)
SPAN_ITEM = _st(span_id=S, parent_span_id=S, name=S, kind=S, start_time_ns=L, end_time_ns=L,
                duration_ns=L, status=S, attributes=S)
EXCEPTION = _st(type=S, message=S, stacktrace=S, sentry_event_id=S)
REQUEST_DETAILS = T.StructType(
    [f for f in REQUEST_LOG_WIRE.fields
     if not f.name.startswith("exception_") and f.name != "sentry_event_id"]
    + [T.StructField("exception", EXCEPTION), T.StructField("logs", T.ArrayType(LOG_ITEM)),
       T.StructField("spans", T.ArrayType(SPAN_ITEM))])


def ts(c) -> F.Column:
    """ISO 8601 text (``Z`` or offset) to TIMESTAMP; an error when it is not a datetime."""
    c = F.col(c) if isinstance(c, str) else c
    bad = F.raise_error(F.concat(F.lit("not a datetime: "), c)).cast("timestamp")
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("timestamp"), bad))


def require(df: DataFrame, *cols: str) -> DataFrame:
    """``df``, with an error for a row in which one of ``cols`` is NULL. The check is a
    filter, so it also runs when the columns are not selected."""
    for c in cols:
        col = F.col(c)
        df = df.filter(F.when(col.isNotNull(), True).otherwise(
            F.raise_error(F.lit(f"a row without {c}")).cast("boolean")))
    return df


def _read(spark: SparkSession, paths, schema, multiline: bool) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(paths)


def whole_fetches(pages: DataFrame) -> DataFrame:
    """``pages``, with an error where a fetch is not whole. The pages of one fetch lie in one folder and
    form a chain: each but the last says ``has_more`` and names a next page of its own, and there
    is one last page. (Pages do not carry their own token, so a lost page in the middle of a
    chain whose end arrived cannot be told.)"""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1)
    more = F.coalesce(F.col("has_more"), F.lit(False))
    chain = pages.groupBy(folder.alias("folder")).agg(
        F.count_if(~more).alias("ends"), F.count_if(more).alias("links"), F.count_distinct(F.when(more, F.col("next_token"))).alias("tokens"))
    broken = F.when(F.col("ends") != 1, F.concat(F.lit("a fetch with "), F.col("ends").cast("string"), F.lit(" last pages: "), F.col("folder"))) \
        .when(F.col("links") != F.col("tokens"), F.concat(F.lit("a page without a next page of its own: "), F.col("folder")))
    problem = chain.select(F.max(broken).alias("p")).scalar()
    return pages.filter(F.when(problem.isNull(), True).otherwise(F.raise_error(problem).cast("boolean")))


def _items(pages: DataFrame, name: str) -> DataFrame:
    """One row per element of the pages' ``data``."""
    return require(pages, "data").select(F.explode("data").alias(name))


def read_apps(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Apps pages -> (apps, app_envs)."""
    items = _items(_read(spark, paths, _page(APP_ITEM), True), "a")
    apps = items.select(F.col("a.id").cast("int").alias("app_id"), F.col("a.name").alias("name"),
                        F.col("a.framework").alias("framework"),
                        F.col("a.client_id").alias("client_id"),
                        ts("a.created_at").alias("created_at"))
    envs = items.select(F.col("a.id").cast("int").alias("app_id"),
                        F.explode("a.envs").alias("e")).select(
        "app_id", F.col("e.id").cast("int").alias("app_env_id"), F.col("e.name").alias("name"),
        ts("e.created_at").alias("created_at"), ts("e.last_sync_at").alias("last_sync_at"))
    return (require(apps, "app_id", "created_at"),
            require(envs, "app_id", "app_env_id", "created_at"))


def read_consumers(spark: SparkSession, paths, app_id: int) -> DataFrame:
    """All consumer pages of one app at once; ``group.name`` becomes ``group``. A fetch that lacks
    its last page is an error (see ``whole_fetches``)."""
    items = _items(whole_fetches(_read(spark, paths, _page(CONSUMER_ITEM, paged=True), True)), "c")
    out = items.select(F.lit(app_id).cast("int").alias("app_id"),
                       F.col("c.id").cast("int").alias("consumer_id"),
                       F.col("c.identifier").alias("identifier"), F.col("c.name").alias("name"),
                       F.col("c.group.name").alias("group"),
                       ts("c.created_at").alias("created_at"),
                       ts("c.last_request_at").alias("last_request_at"))
    return require(out, "consumer_id", "created_at")


def read_endpoints(spark: SparkSession, paths, app_id: int) -> DataFrame:
    items = _items(_read(spark, paths, _page(ENDPOINT_ITEM), True), "e")
    return require(items.select(F.lit(app_id).cast("int").alias("app_id"),
                        F.col("e.id").cast("int").alias("endpoint_id"),
                        F.col("e.method").alias("method"), F.col("e.path").alias("path")),
                   "endpoint_id", "method", "path")


def read_metrics_ndjson(spark: SparkSession, paths, app_id: int) -> DataFrame:
    """Metrics NDJSON (any subset of columns) aligned to the metrics table."""
    raw = _read(spark, paths, METRICS_WIRE, False)
    raw = raw.withColumn("period_start", ts("period_start")).withColumn("period_end",
                                                                         ts("period_end"))
    return require(align(raw, "metrics", app_id), "period_start", "period_end")


def logs_from_wire(df: DataFrame, app_id: int, keep: tuple[str, ...] = ()) -> DataFrame:
    d = (df.withColumn("timestamp", ts("timestamp"))
         .withColumn("request_headers", reshape_lists(F.col("request_headers")))
         .withColumn("response_headers", reshape_lists(F.col("response_headers"))))
    return align(d, "request_logs", app_id, keep)


def read_request_logs_ndjson(spark: SparkSession, paths, app_id: int) -> DataFrame:
    """Request-log NDJSON; ``[name, value]`` header pairs become name/value structs."""
    out = logs_from_wire(_read(spark, paths, REQUEST_LOG_WIRE, False), app_id)
    return require(out, "timestamp", "request_uuid", "method", "url")


def read_request_details(spark: SparkSession, paths, app_id: int
                         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Request-details documents -> (request_logs, application_logs, spans).

    The exception object is flattened into four columns; ``attributes`` keeps its JSON
    text; fields not in the schema (e.g. ``consumer``) are ignored.
    """
    return details_frames(_read(spark, paths, REQUEST_DETAILS, True), app_id)


def details_frames(raw: DataFrame, app_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split request-details rows (``REQUEST_DETAILS`` schema) into the three tables."""
    req = raw.select(*[c for c in raw.columns if c not in ("exception", "logs", "spans")],
                     F.col("exception.type").alias("exception_type"),
                     F.col("exception.message").alias("exception_message"),
                     F.col("exception.stacktrace").alias("exception_stacktrace"),
                     F.col("exception.sentry_event_id").alias("sentry_event_id"))
    logs = raw.select("request_uuid", F.explode("logs").alias("l")).select(
        F.lit(app_id).cast("int").alias("app_id"), "request_uuid",
        ts("l.timestamp").alias("timestamp"), F.col("l.message").alias("message"),
        F.col("l.level").alias("level"), F.col("l.logger").alias("logger"),
        F.col("l.file").alias("file"), F.col("l.line").alias("line"))
    spans = raw.select("request_uuid", F.explode("spans").alias("s")).select(
        F.lit(app_id).cast("int").alias("app_id"), "request_uuid", "s.*")
    return (require(logs_from_wire(req, app_id), "timestamp", "request_uuid"),
            require(logs, "timestamp", "message"), require(align_spans(spans), "span_id"))


def align_spans(spans: DataFrame) -> DataFrame:
    return align(spans, "spans")
