"""Span trees and request-details documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.session import checkpoint_dir

KEYS = ["app_id", "request_uuid"]


def _chains(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans with the chain to their root, spans whose chain runs into a parent cycle).

    ``spans`` has KEYS, span_id, name and _above (the parent, NULL for a root). Pointer
    doubling: a step joins every unfinished span with its ancestor's own chain, so chains
    double. Finished spans are set aside and not written again. A chain that meets a span id
    it already holds runs into a cycle: its span lies on the cycle if it meets itself.
    """
    todo = spans.select(*KEYS, "span_id", "_above", F.array("name").alias("_names"), F.array("span_id").alias("_ids")).checkpoint()
    done, cyclic = [], []
    while True:
        done.append(todo.filter("_above IS NULL").drop("_above"))
        todo = todo.filter("_above IS NOT NULL")
        if todo.isEmpty():
            break
        chains = reduce(DataFrame.unionByName, [*[d.withColumn("_above", F.lit(None).cast("string")) for d in done], todo])
        upper = chains.select(*KEYS, F.col("span_id").alias("_above"), F.col("_above").alias("_next"),
                              F.col("_names").alias("_upper_names"), F.col("_ids").alias("_upper_ids"))
        # an ancestor whose chain is no more among them ran into a cycle before
        met = F.coalesce(F.arrays_overlap("_ids", "_upper_ids"), F.lit(True))
        on = F.coalesce(F.array_contains("_upper_ids", F.col("span_id")), F.lit(False))
        step = (todo.join(upper, [*KEYS, "_above"], "left")
                .select(*KEYS, "span_id", F.col("_next").alias("_above"), met.alias("_met"), on.alias("_on"),
                        F.when(~met, F.concat("_upper_names", "_names")).alias("_names"), F.when(~met, F.concat("_upper_ids", "_ids")).alias("_ids"))
                .checkpoint())
        cyclic.append(step.filter("_met").select(*KEYS, "span_id", "_on"))
        todo = step.filter("NOT _met").drop("_met", "_on")
    empty = spans.limit(0).select(*KEYS, "span_id", F.lit(True).alias("_on"))
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, cyclic, empty)


def span_tree(spans: DataFrame) -> DataFrame:
    """Every span with its place below its root span, through ``parent_span_id``.

    Returns app_id, request_uuid, span_id, parent_span_id, name, depth (root = 0), path
    (names root-to-span joined by `` > ``), n_children, place (1-based among its siblings, by start
    time and then id), subtree (spans in its subtree, itself included) and cycle. A span without
    a parent, or whose parent is not in the data (late or never captured), is a root. A span
    on a cycle of parents is a root too, marked ``cycle``, and what hangs below it keeps its
    place there; the parent_span_id of every span stays as captured.

    The number of steps (each one equi-join on (app_id, request_uuid, ancestor = span_id),
    checkpointed into the shared folder) is the logarithm of the depth, and work spreads by
    span, not by trace.
    """
    checkpoint_dir(spans.sparkSession)
    cols = ["app_id", "request_uuid", "span_id", "parent_span_id", "name"]
    s = spans.select(*cols, *(["start_time_ns"] if "start_time_ns" in spans.columns else [F.lit(None).cast("bigint").alias("start_time_ns")]))
    present = s.select(*KEYS, F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_found")).distinct()
    linked = s.join(present, [*KEYS, "parent_span_id"], "left").select(*cols, "start_time_ns", F.when(F.col("_found"), F.col("parent_span_id")).alias("_above"))
    chains, cyclic = _chains(linked)
    chains = chains.withColumn("cycle", F.lit(False))
    if not cyclic.isEmpty():
        on = cyclic.withColumnRenamed("_on", "cycle")
        cut = linked.join(on, [*KEYS, "span_id"]).withColumn("_above", F.when(~F.col("cycle"), F.col("_above")))
        below, _ = _chains(cut)
        chains = chains.unionByName(below.join(on, [*KEYS, "span_id"]))
    chains = chains.checkpoint()
    # a span's parent in the tree is the last but one of its chain
    placed = (chains.select(*KEYS, "span_id", F.try_element_at("_ids", F.lit(-2)).alias("_above"))
              .join(s.select(*KEYS, "span_id", "start_time_ns"), [*KEYS, "span_id"])
              .withColumn("place", F.row_number().over(Window.partitionBy(*KEYS, "_above").orderBy("start_time_ns", "span_id"))))
    below = chains.select(*KEYS, F.explode("_ids").alias("span_id")).groupBy(*KEYS, "span_id").agg(F.count(F.lit(1)).alias("subtree"))
    kids = (placed.filter("_above IS NOT NULL").groupBy(*KEYS, F.col("_above").alias("span_id")).agg(F.count(F.lit(1)).alias("n_children")))
    return (chains.join(placed.select(*KEYS, "span_id", "place"), [*KEYS, "span_id"]).join(below, [*KEYS, "span_id"]).join(kids, [*KEYS, "span_id"], "left")
            .join(s.select(*cols), [*KEYS, "span_id"])
            .select(*cols, (F.size("_names") - 1).alias("depth"), F.array_join("_names", " > ").alias("path"),
                    F.coalesce("n_children", F.lit(0)).alias("n_children"), "place", "subtree", "cycle"))


def child_counts(request_logs: DataFrame, application_logs: DataFrame,
                 spans: DataFrame) -> DataFrame:
    """Per request: number of application logs and spans (aggregated before the join)."""
    nl = application_logs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_logs"))
    ns = spans.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_spans"))
    return (request_logs.select(*KEYS).join(nl, KEYS, "left").join(ns, KEYS, "left")
            .select(*KEYS, F.coalesce("n_logs", F.lit(0)).alias("n_logs"),
                    F.coalesce("n_spans", F.lit(0)).alias("n_spans")))


def request_details(request_logs: DataFrame, application_logs: DataFrame, spans: DataFrame,
                    request_uuid: str, app_id: int | list[int]) -> DataFrame:
    """The request-details document of one request of ``app_id`` (or of several apps): its log row, exception as a struct,
    ``logs`` (by timestamp) and ``spans`` (by start time) as arrays; ``[]`` when none.

    The lookup key is applied to all three inputs before grouping, so only that request's
    children are gathered into its arrays.
    """
    def pick(df):
        ids = app_id if isinstance(app_id, (list, tuple, set)) else [app_id]
        return df.filter(F.col("app_id").isin(*ids) & (F.col("request_uuid") == F.lit(request_uuid)))

    log_cols = ["timestamp", "message", "level", "logger", "file", "line"]
    if "seq" in application_logs.columns:
        log_cols.insert(1, "seq")
    logs = (pick(application_logs).groupBy(*KEYS)
            .agg(F.sort_array(F.collect_list(F.struct(*log_cols))).alias("logs")))
    span_cols = ["start_time_ns", "span_id", "parent_span_id", "name", "kind", "end_time_ns",
                 "duration_ns", "status", "attributes"]
    sp = (pick(spans).groupBy(*KEYS)
          .agg(F.sort_array(F.collect_list(F.struct(*span_cols))).alias("spans")))
    req = pick(request_logs)
    exc = F.when(F.col("exception_type").isNotNull() | F.col("exception_message").isNotNull(),
                 F.struct(F.col("exception_type").alias("type"),
                          F.col("exception_message").alias("message"),
                          F.col("exception_stacktrace").alias("stacktrace"),
                          F.col("sentry_event_id").alias("sentry_event_id")))
    base_cols = [c for c in req.columns if not c.startswith("exception_")
                 and c != "sentry_event_id"]
    out = req.select(*base_cols, exc.alias("exception")).join(logs, KEYS, "left") \
        .join(sp, KEYS, "left")
    out = (out.withColumn("logs", F.coalesce("logs", F.array().cast(logs.schema["logs"].dataType)))
           .withColumn("spans", F.coalesce("spans", F.array().cast(sp.schema["spans"].dataType))))
    # the key joins move app_id/request_uuid first; keep the document's field order
    return out.select(*base_cols, "exception", "logs", "spans")


def request_details_json(doc: DataFrame) -> DataFrame:
    """The request-details document as one JSON text per request, in the wire shape:
    headers as ``[name, value]`` pairs, ``exception`` object (or null), ``logs`` and
    ``spans`` arrays with span ``attributes`` as a JSON object. NULL fields stay ``null``."""
    def pairs(c):
        return F.transform(F.col(c), lambda x: F.array(x["name"], x["value"]))

    span_t = F.transform("spans", lambda s: F.struct(
        s["span_id"].alias("span_id"), s["parent_span_id"].alias("parent_span_id"),
        s["name"].alias("name"), s["kind"].alias("kind"),
        s["start_time_ns"].alias("start_time_ns"), s["end_time_ns"].alias("end_time_ns"),
        s["duration_ns"].alias("duration_ns"), s["status"].alias("status"),
        F.try_parse_json(s["attributes"]).alias("attributes")))
    log_t = F.transform("logs", lambda x: F.struct(
        F.date_format(x["timestamp"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        x["message"].alias("message"), x["level"].alias("level"), x["logger"].alias("logger"),
        x["file"].alias("file"), x["line"].alias("line")))
    fields = []
    for c in doc.columns:
        if c == "app_id":
            continue
        if c in ("request_headers", "response_headers"):
            fields.append(pairs(c).alias(c))
        elif c == "timestamp":
            fields.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c))
        elif c == "spans":
            fields.append(span_t.alias(c))
        elif c == "logs":
            fields.append(log_t.alias(c))
        else:
            fields.append(F.col(c))
    return doc.select("app_id", "request_uuid",
                      F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
