"""Exact top-k inner-product search with multi-resolution segment statistics.

For a vector cut into segments, the mean and the deviation of each segment bound the inner
product from above: q.v <= sum over segments of (length mean_q mean_v + norm_q norm_v), the
norms being those of the segments about their means (the same statistics bound the distance
|q - v|^2 = |q|^2 + |v|^2 - 2 q.v from below). A bound with S segments is one product of
2 S numbers a vector, so levels run coarse to fine: 1, 4, 16 ... segments. Each level keeps
the pairs that can still reach the query's k-th best score so far; survivors of the last
level get the exact integer score.

Vectors are dealt to blocks; the query set (one row in a hundred) is dealt to query blocks,
and every query block meets every vector block once, in one task each. Only k rows per
query and vector block leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.exchange import released

SCALE = 1024
#: vectors and queries of a block; a pair of blocks is one task's work
VECTORS, QUERIES = 8192, 1024
#: queries compared at once inside a task, which bounds the matrix of bounds
STEP = 64


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(sqrt(length) x mean, norm about the mean) of each segment of each row of x."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    mean, norm = np.empty((len(x), segments)), np.empty((len(x), segments))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = x[:, a:b]
        m = part.mean(axis=1)
        mean[:, i] = np.sqrt(b - a) * m
        norm[:, i] = np.sqrt(((part - m[:, None]) ** 2).sum(axis=1))
    return mean, norm


def levels(dim: int) -> list[int]:
    """Segment counts, coarse to fine."""
    return [s for s in (1, 4, 16, 64) if 2 * s <= dim]


def best_of_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of a block for each query: (query index, vector index, score).

    Components are whole numbers; scores are exact: in doubles while every partial sum stays
    below 2^53, in Python integers beyond that.
    """
    top = float(max(np.abs(q).max(initial=0), 1) * max(np.abs(v).max(initial=0), 1)) * q.shape[1]
    small = top < 2**53
    stats = [(*segment_statistics(q, s), *segment_statistics(v, s)) for s in levels(q.shape[1])]
    slack = 1.0 + top * 1e-12  # more than the bounds' rounding errors

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if small:
            return np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], v[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.empty(0)])
        return np.array([sum(int(x) * int(y) for x, y in zip(q[a], v[b])) for a, b in zip(i, j)], object)

    out_q, out_v, out_s = [], [], []
    for a in range(0, len(qid), STEP):
        rows = np.arange(a, min(a + STEP, len(qid)))
        live = vid[None, :] != qid[rows, None]
        bound = np.full(live.shape, np.inf)
        threshold = np.full(len(rows), -np.inf)
        for qm, qn, vm, vn in stats:
            if live.mean() > 0.2:  # most pairs are left: one matrix product
                bound = np.where(live, qm[rows] @ vm.T + qn[rows] @ vn.T, -np.inf)
            else:
                i, j = np.nonzero(live)
                bound = np.full(live.shape, -np.inf)
                bound[i, j] = (qm[rows[i]] * vm[j] + qn[rows[i]] * vn[j]).sum(axis=1)
            m = min(4 * k, bound.shape[1])
            if small and m:  # exact scores of the most promising give a k-th best score to reach
                first = np.argpartition(-bound, m - 1, axis=1)[:, :m]
                score = np.einsum("id,ijd->ij", q[rows], v[first])
                score[~np.take_along_axis(live, first, 1)] = -np.inf
                if m >= k:
                    threshold = np.maximum(threshold, np.partition(score, m - k, axis=1)[:, m - k])
            live &= bound + slack >= threshold[:, None]
        i, j = np.nonzero(live)
        s = exact(rows[i], j)
        order = np.lexsort((vid[j], -s, i)) if small else np.array(sorted(range(len(i)), key=lambda z: (i[z], -s[z], vid[j[z]])), int)
        i, j, s = i[order], j[order], s[order]
        start = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1] if len(i) else np.empty(0, int)
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
        keep = place < k
        out_q.append(rows[i[keep]])
        out_v.append(j[keep])
        out_s.append(s[keep])
    e = np.empty(0, int)
    return (np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)) if out_q else (e, e, e)


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): components floor(scale x), without null or non-finite ones."""
    x = F.col("embedding").cast("array<double>")
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
            .select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v")))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """The k highest integer inner products of every query: (query_id, rank, vec_id, score).

    Queries are the rows with vec_id divisible by ``every``; candidates are all rows of the
    same length but those of the query's own vec_id. Ties go to the smaller vec_id; repeated
    candidates count one by one. A vec_id on several rows is one query and has one list, that of
    its longest, then greatest vector. Vectors that are null or hold a null or non-finite
    component, and rows with a null vec_id, take no part. Fewer candidates than k give fewer
    rows. Extra columns are ignored. A score beyond 64 bits raises an error.
    """
    spark = vectors.sparkSession
    v = whole_numbers(vectors, scale)
    n, nq = v.select(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nb, ng = max(min(slots, -(-n // 1024)), -(-n // VECTORS), 1), max(-(-nq // QUERIES), 1)
    mine = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(nb)).cast("int")
    left = v.select("dim", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(ng - 1))).alias("query_block"), "vec_id", "v")
    # one query a vec_id, whatever repeats
    queries = v.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    right = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(ng)).cast("int").alias("query_block"), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, flat = t["vec_id"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], np.ascontiguousarray(x[order])

    def search(vs: pa.Table, qs: pa.Table) -> pa.Table:
        if not vs.num_rows or not qs.num_rows:
            return pa.table([[]] * 3, schema)
        vid, x = matrix(vs)
        qid, q = matrix(qs)
        i, j, s = best_of_block(qid, q, vid, x, k)
        return pa.table([pa.array(qid[i]), pa.array(vid[j]), pa.array([int(z) for z in s], pa.int64())], schema)

    key = ("dim", "block", "query_block")
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(released(search, 2), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
