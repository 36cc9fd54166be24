"""Write semantics as pure functions ``(base, staged) -> new_base``.

Parquet tables have no MERGE or DELETE, so each refetch produces the next version of a
table from the current one:

* ``upsert``           INSERT OR REPLACE on the table's unique key (whole-row replace).
* ``range_replace``    metrics: drop base rows of the same app whose period lies inside
                       [min(staged.period_start), max(staged.period_end)], then append.
* ``replace_children`` application_logs / spans: drop every child of the fetched
                       parents, then append the fetched children.
* ``align``            INSERT BY NAME: canonical column set and types, missing -> NULL.

All are anti-joins plus a union: one shuffle on the key for each side, or none for the
base where adaptive execution measures the staged keys as small enough to broadcast.
``upsert`` shuffles its staged rows once more before that (``spread``, in ``dedup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.schemas import TABLE_KEYS, TABLES


def align(df: DataFrame, table: str, app_id: int | None = None,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``table`` in canonical order and type; absent ones are NULL, extra ones
    but those in ``keep`` dropped; ``app_id`` (when given) is stamped on every row."""
    have = set(df.columns)
    cols = []
    for f in TABLES[table].fields:
        if f.name == "app_id" and app_id is not None:
            c = F.lit(app_id)
        elif f.name in have:
            c = F.col(f"`{f.name}`")
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols, *keep)


#: Up to so many partitions a map task writes its shuffle rows straight to files (Spark's
#: ``spark.shuffle.sort.bypassMergeThreshold``); beyond, it gathers them in memory.
_STREAMED_PARTITIONS = 200


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by key into partitions of about the advisory size: adaptive execution merges
    small ones and has one that a hot key makes large read by several tasks. A stage that
    sorts whole rows after this holds such a partition, not all that an input split unfolds
    to. Without adaptive execution a hot key would meet in one task: rows stay where they are."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.adaptive.enabled") != "true":
        return df
    n = min(_STREAMED_PARTITIONS, int(conf.get("spark.sql.shuffle.partitions")))
    return df.withColumn("_deal", F.xxhash64(*keys)).hint("rebalance", n, "_deal").drop("_deal")


def dedup(staged: DataFrame, keys: list[str], newest: tuple[str, ...] = (),
          clustered: bool = False) -> DataFrame:
    """One row per key. Among duplicates inside one batch the newest wins, by the columns
    ``newest`` (compared in order); ties, and all duplicates without them, go to the
    greatest row over all its columns, so the result does not depend on partitioning.
    Aggregation is partial, over partitions of bounded size (see ``spread``): duplicates of a
    hot key collapse per task before the shuffle by key. ``clustered``: the rows already come
    from a shuffle by key and need no spreading."""
    rest = [*newest, *[c for c in staged.columns if c not in keys and c not in newest]]
    if not rest:
        return staged.dropDuplicates(keys)
    if not clustered:
        staged = spread(staged, keys)
    packed = F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row")
    return staged.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.`{c}`").alias(c)
                                                          for c in rest]) \
        .select(*staged.columns)


def upsert(base: DataFrame, staged: DataFrame, keys: list[str] | None = None,
           table: str | None = None, app_id: int | None = None,
           dedupe: bool = True, newest: tuple[str, ...] = ()) -> DataFrame:
    """INSERT OR REPLACE: staged rows replace base rows with the same key. With ``table``
    the staged rows are first aligned to its full schema, so fields that were not fetched
    become NULL (whole-row replacement, old values are not kept). ``newest`` names staged
    columns that order a key's duplicates (see ``dedup``); they are not stored."""
    keys = keys or TABLE_KEYS[table]
    if table is not None and app_id is not None:
        staged = staged.withColumn("app_id", F.lit(app_id))
    if dedupe:
        staged = dedup(staged, keys, newest)
    if table is not None:
        staged = align(staged, table)
        base = align(base, table)
    kept = base.join(staged.select(*keys), keys, "left_anti")
    return kept.unionByName(staged)


def range_replace(base: DataFrame, staged: DataFrame, start: str = "period_start",
                  end: str = "period_end") -> DataFrame:
    """Metrics refetch. Per app, delete base rows *contained* in the staged bounds (a row
    straddling an edge survives; interval, grouping and env are not looked at), then
    append the staged rows. Empty staged rows give no bounds and delete nothing."""
    bounds = staged.groupBy("app_id").agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    j = base.join(bounds, "app_id", "left")
    inside = (F.col(start) >= F.col("_lo")) & (F.col(end) <= F.col("_hi"))
    kept = j.filter(~F.coalesce(inside, F.lit(False))).drop("_lo", "_hi")
    return kept.unionByName(staged, allowMissingColumns=True)


def range_replace_fetches(base: DataFrame, staged: DataFrame, fetch: str, order: tuple[str, ...],
                          start: str = "period_start", end: str = "period_end") -> DataFrame:
    """``range_replace`` for several fetches that arrived together. Each fetch (``fetch``
    names it; the columns ``order`` say which came later) has bounds of its own per app:
    it deletes the base rows inside them and the rows of earlier fetches inside them, so
    the outcome is that of applying the fetches one after the other, and a fetch delivered
    twice leaves its rows once. ``fetch`` and ``order`` are not stored."""
    seq = F.struct(*[F.col(c) for c in order], F.col(fetch)).alias("_seq")
    staged = staged.withColumn("_seq", seq)
    bounds = staged.groupBy("app_id", "_seq").agg(F.min(start).alias("_lo"), F.max(end).alias("_hi")) \
        .select(F.col("app_id").alias("_app"), F.col("_seq").alias("_by"), "_lo", "_hi")
    inside = (F.col("app_id") == F.col("_app")) & (F.col(start) >= F.col("_lo")) & (F.col(end) <= F.col("_hi"))
    kept = base.join(bounds, inside, "left_anti")
    last = staged.join(bounds, inside & (F.col("_by") > F.col("_seq")), "left_anti")
    return kept.unionByName(last.drop("_seq", fetch, *order), allowMissingColumns=True)


def replace_children(base: DataFrame, staged: DataFrame, parents: DataFrame,
                     keys: tuple[str, ...] = ("app_id", "request_uuid")) -> DataFrame:
    """Children refetch: every child of a fetched parent is replaced by the fetched
    children, so a parent now without children loses its old ones."""
    keys = list(keys)
    kept = base.join(parents.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(staged, allowMissingColumns=True)
