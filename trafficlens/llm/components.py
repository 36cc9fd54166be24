"""Connected components: edges contracted inside partitions, then either one bounded task or
alternating large and small stars, each round checkpointed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.exchange import checkpointed, give_back

#: parts in which a vertex's larger neighbours meet its smallest one
SALTS = 8
#: contracted edges, counted beforehand, that one task solves (16 bytes each); more take rounds of stars
TOGETHER = 1 << 20
#: edges that a task gathers before it contracts them
GATHERED = 1 << 18


def lowest_vertex(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of n vertices, from an edge list."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def spanning_stars(cols: list[np.ndarray]) -> list[np.ndarray]:
    """(group..., id, smallest id of its component) for the edges (group..., a, b), roots left out, in order.

    A function of the set of edges alone, whatever their order."""
    *groups, a, b = cols
    code = np.zeros(len(a), np.int64)
    for g in groups:
        of = np.unique(g, return_inverse=True)[1]
        code = code * (of.max(initial=0) + 1) + of
    ends = np.r_[a, b]
    ids, place = np.unique(ends, return_inverse=True)
    first, vertex = np.unique(np.r_[code, code] * len(ids) + place, return_index=True, return_inverse=True)[1:]
    root = lowest_vertex(vertex[: len(a)], vertex[len(a) :], len(first))
    rest = np.flatnonzero(root != np.arange(len(root)))
    return [*[np.r_[g, g][first[rest]] for g in groups], ends[first[rest]], ends[first[root[rest]]]]


def contracted(pairs: DataFrame) -> DataFrame:
    """The edges of each partition replaced by a spanning forest of stars; a task holds one row a vertex."""
    names, schema = pairs.columns, pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = None, 0
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = [[h, n] for h, n in zip(held, new, strict=True)] if held and isinstance(held[0], np.ndarray) else [h + [n] for h, n in zip(held, new, strict=True)] if held else [[n] for n in new]
            more += batch.num_rows
            if more >= GATHERED:
                held, more = spanning_stars([np.concatenate(h) for h in held]), 0
        if held:
            out = spanning_stars(held if isinstance(held[0], np.ndarray) else [np.concatenate(h) for h in held])
            for at in range(0, len(out[0]), GATHERED):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + GATHERED]) for c in out], names=names)
        give_back()

    return pairs.mapInArrow(run, schema)


def components(edges: DataFrame, *group: str) -> DataFrame:
    """(group..., id, root) for every id of ``edges`` (group..., a, b): root is the smallest id of its component.

    Each partition's edges become a forest first, so what is shuffled grows with the vertices
    and not with the edges. If at most TOGETHER edges are left, one task ends the work; else
    rounds follow. A round links every vertex's larger neighbours to its smallest neighbour (large star),
    then its smaller ones (small star); rounds are logarithmic in number. Only minima are
    aggregated, so a vertex with many neighbours is never gathered, and its edges meet its
    minimum in SALTS parts, in both joins. Both ways give the same rows. Loops are ignored;
    repeated edges count once; no edges give no rows. Ids and groups are not null.
    """
    g = list(group)

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(*g, "a").agg(F.min("b").alias("m"))

    part = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")

    def in_all_parts(low: DataFrame) -> DataFrame:
        return low.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*g, "a", "b").cast("decimal(38,0)"))).first())

    # every pair points from the larger id to the smaller
    pairs = edges.filter("a <> b").select(*g, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = checkpointed(contracted(pairs).distinct())
    before, few = None, pairs.count() <= TOGETHER
    if few:
        pairs = checkpointed(contracted(pairs.coalesce(1)))
    while not few and (now := state(pairs)) != before:
        before = now
        both = pairs.unionByName(pairs.select(*g, F.col("b").alias("a"), F.col("a").alias("b")))
        low = lowest(both).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").withColumn("salt", part).join(in_all_parts(low), [*g, "a", "salt"]).select(*g, F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        low = lowest(large)
        small = large.withColumn("salt", part).join(in_all_parts(low), [*g, "a", "salt"]).select(*g, F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        pairs = checkpointed(small.unionByName(low.select(*g, "a", F.col("m").alias("b"))).distinct())
    return pairs.select(*g, F.col("a").alias("id"), F.col("b").alias("root")).unionByName(pairs.select(*g, F.col("b").alias("id"), F.col("b").alias("root")).distinct())
