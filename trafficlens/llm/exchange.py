"""Blocks of documents and the packed key exchange between them.

Documents are dealt to blocks by a hash of their id and text, so copies of one text with
different ids spread evenly. Each block reduces its keys to distinct ones (a hot key leaves
a block once, whatever its count), packs them per bucket and sends them as one binary row;
a bucket task answers each block with one value per key, in the block's own sorted order.
Keys carry 32 (or 64) bits beside the bucket number, so their width grows with the data.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.session import checkpoint_dir

U = np.uint64
#: text bytes of a block, by default; one block at a time is in a Python worker, which needs some 30 times that
BLOCK_BYTES = 4 << 20
#: more buckets than this would make rows of a few keys each
MAX_BUCKETS = 200_000


def count_blocks(docs: DataFrame, text: str = "text") -> int:
    """Blocks for the whole text (one scan of its lengths), at least one per shuffle partition.

    ``spark.trafficlens.blockBytes`` sets a block's size: larger blocks send fewer, longer rows.
    """
    spark = docs.sparkSession
    block_bytes = int(spark.conf.get("spark.trafficlens.blockBytes", str(BLOCK_BYTES)))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))


def block_rows(docs: DataFrame, n: int) -> DataFrame:
    """(block, doc_id, text), where they are."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def in_blocks(docs: DataFrame, n: int) -> DataFrame:
    """(block, doc_id, text) dealt by block over the session's shuffle partitions (never more
    than blocks): a partition holds several blocks, a Python worker one at a time."""
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return block_rows(docs, n).repartition(min(n, slots), "block")


def text_parts(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.Table]:
    """The batch in slices of about ``size`` text bytes, one document at least."""
    t = pa.Table.from_batches([batch])
    length = np.array([len(x) if x else 0 for x in batch["text"].cast(pa.binary()).to_pylist()])
    a = 0
    while a < batch.num_rows:
        b = a + max(1, int(np.searchsorted(np.cumsum(length[a:]), size, "right")))
        yield t.slice(a, b - a)
        a = b


def buckets_for(n_blocks: int) -> int:
    return min(n_blocks, MAX_BUCKETS)


def route(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the high half, 32 more bits of the key in the low half."""
    return ((keys >> U(32)) % U(n)) << U(32) | keys & U(0xFFFFFFFF)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    n = len(sorted_values)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return start, np.r_[start[1:], n]


PACKED = "bucket int, block int, keys binary, more binary"
ANSWER = "block int, phase int, bucket int, bits binary"


def pack_flags(block: int, keys: np.ndarray, flags: np.ndarray) -> pa.Table:
    """Rows of PACKED from sorted distinct routed keys and a flag for each."""
    cols: dict[str, list] = {"bucket": [], "block": [], "keys": [], "more": []}
    low = keys.astype(np.uint32)
    for a, b in zip(*runs(keys >> U(32)), strict=True):
        cols["bucket"].append(int(keys[a] >> U(32)))
        cols["block"].append(block)
        cols["keys"].append(low[a:b].tobytes())
        cols["more"].append(np.packbits(flags[a:b]).tobytes())
    return pa.table(cols, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())]))


def answers(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["block", "phase", "bucket", "bits"])


def shared_keys(packed: DataFrame, phase: int) -> DataFrame:
    """For each packed key one bit: it occurs in two documents or more, of any blocks."""

    def merge(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        blocks = t["block"].to_pylist()
        order = np.argsort(np.array(blocks), kind="stable")
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in t["keys"]]
        flags = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)) for x, k in zip(t["more"], keys, strict=True)]
        keys, flags = [keys[i] for i in order], [flags[i] for i in order]
        all_keys = np.concatenate(keys)
        by = np.argsort(all_keys, kind="stable")
        start, end = runs(all_keys[by])
        seen = np.add.reduceat(1 + np.concatenate(flags)[by].astype(np.int64), start)
        shared = np.empty(len(by), bool)
        shared[by] = np.repeat(seen >= 2, end - start)
        out, at = [], 0
        for i, k in zip(order, keys, strict=True):
            out.append((blocks[i], phase, bucket, np.packbits(shared[at : at + len(k)]).tobytes()))
            at += len(k)
        return answers(out)

    return per_group(packed, "bucket", merge, ANSWER)


def give_back() -> None:
    """Freed memory of this Python process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(work: Callable[..., pa.Table], inputs: int = 1) -> Callable[..., pa.Table]:
    """work, after which the Python worker gives freed memory back to the system: idle workers stay alive."""

    def run(*tables: pa.Table) -> pa.Table:
        out = work(*tables)
        give_back()
        return out

    return (lambda table: run(table)) if inputs == 1 else (lambda left, right: run(left, right))


def per_group(df: DataFrame, key: str, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.groupBy(key).applyInArrow(released(work), schema)


def answer_parts(answer: pa.Table, phase: int) -> dict[int, bytes]:
    """bucket -> bits of one phase, for one block."""
    return {b: x for p, b, x in zip(answer["phase"].to_pylist(), answer["bucket"].to_pylist(), answer["bits"].to_pylist(), strict=True) if p == phase}


def read_flags(parts: dict[int, bytes], keys: np.ndarray) -> np.ndarray:
    """The bit of each of the block's sorted distinct routed keys."""
    out = np.zeros(len(keys), bool)
    for a, b in zip(*runs(keys >> U(32)), strict=True):
        bits = parts[int(keys[a] >> U(32))]
        if len(bits) != -(-(b - a) // 8):
            raise ValueError("a block's keys differ from those it sent")
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out


def with_answers(blocks: DataFrame, answer: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each block beside what the buckets answered."""
    return blocks.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(released(work, 2), schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut.

    Then the driver collects its garbage: Spark drops shuffles, broadcasts and checkpoints only
    when the driver's references to them are collected, and many small rounds would otherwise
    pile them (and the plans of the rounds) up until its heap is full."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint()
    spark.sparkContext._jvm.System.gc()
    give_back()
    return out
