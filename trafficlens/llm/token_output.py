"""Training-order materialisation: tokens to fixed-length sequences, sequences to shuffled fixed-stride shards.

Documents are tokenised, joined with an end-of-text token within each input partition and
cut into sequences of a fixed number of tokens (only a partition's last one is padded). A
sequence's number is its partition's offset plus its place there; a keyed Feistel network
over the smallest even-bit domain that holds all numbers, walked along its cycle until it
falls below the count, permutes the numbers into global slots. The permutation is a
bijection computed from the number alone, so no random column is sorted and any slot can be
traced back. Sequences are range-partitioned by slot, and each task writes whole shards:
slot s is record s % per_shard of shard s // per_shard, at a fixed byte offset, so a reader
resumes anywhere with one seek.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.hashing import span_hashes
from trafficlens.session import checkpoint_dir

#: public byte-level BPE ranks, an example of the ``ranks`` parameter
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
LENGTH = 2048
SHARD_BYTES = 16 << 20
ROUNDS = 4
U = np.uint64

_tokenizers: dict[str, object] = {}


#: words whose number of tokens a worker remembers, and texts that are counted together
REMEMBERED, TOGETHER = 200_000, 1000
_WIDE_SPACE = re.compile(r"\s\s")


class Tokenizer:
    """Token ids of a text, by the merge ranks of a public byte-level vocabulary."""

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        if max(table.values()) >= 1 << 16:
            raise ValueError("token ids must fit 16 bits")
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        self.lengths: dict[bytes, int] = {}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def count(self, texts: list[str]) -> int:
        """Tokens of all texts together: sum of len(encode(text)).

        A lone space between two other characters always begins a new piece of the
        pattern, so what stands between such spaces counts by itself. The distinct words of
        the texts are found by their hashes; those met once are encoded in a single call.
        Texts with wider spaces are encoded whole.
        """
        total, heads, tails = 0, [], []
        for text in texts:
            head, space, tail = text.partition(" ")
            heads.append(head)
            if space:
                tails.append(tail)
        raw = " ".join(tails).encode()
        buf = np.frombuffer(raw, np.uint8)
        spaces = np.flatnonzero(buf == 32)
        starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(buf)]
        if tails and (ends > starts).all():
            h = span_hashes(buf, starts, ends)
            order = np.argsort(h)
            h = h[order]
            lead = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            times = np.diff(np.r_[lead, len(h)])
            which = order[lead]
            words = [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        else:
            words, times = [b""] * len(tails[:1]), np.ones(len(tails[:1]), np.int64)
        if _WIDE_SPACE.search(f"x {' '.join(heads)} x") or words and _WIDE_SPACE.search(f"x {b' '.join(words).decode()} x"):
            wide = [bool(_WIDE_SPACE.search(f"x {t} x")) for t in texts]
            plain = [t for t, w in zip(texts, wide, strict=True) if not w]
            return sum(len(self.encode(t)) for t, w in zip(texts, wide, strict=True) if w) + (self.count(plain) if plain else 0)
        total += sum(len(self.encode(h)) for h in heads)
        once = []
        for word, n in zip(words, times.tolist(), strict=True):
            if n == 1:
                once.append(word)
                continue
            tokens = self.lengths.get(word)
            if tokens is None:
                tokens = len(self.encode(" " + word.decode()))
                if len(self.lengths) < REMEMBERED:
                    self.lengths[word] = tokens
            total += n * tokens
        return total + (len(self.encode(" " + b" ".join(once).decode())) if once else 0)


def tokenizer(ranks: str) -> Tokenizer:
    if ranks not in _tokenizers:
        _tokenizers[ranks] = Tokenizer(ranks)
    return _tokenizers[ranks]


def feistel(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed permutation of 0 .. n-1: a Feistel network on 2 h bits, cycle-walked into the range."""
    from trafficlens.llm.hashing import mix

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U(half), v & low
        for r in range(rounds):
            left, right = right, left ^ (mix(right + U(r << 40), key + r) & low)
        return left << U(half) | right

    out = once(x.astype(U))
    while (outside := out >= U(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], ranks: str, length: int, end: int) -> Iterator[tuple[bytes, int, list[int | None]]]:
    """(tokens as bytes, tokens before padding, doc_ids in order) of each sequence of one partition."""
    enc, width = tokenizer(ranks), 2 * length
    close = int(end).to_bytes(2, "little")
    held, ids = bytearray(), []  # ids: (doc_id, end offset in held)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                if text:
                    held += np.array(enc.encode(text), "<u2").tobytes()
                    held += close
                    ids.append((doc, len(held)))
                at = 0
                while len(held) - at >= width:
                    yield bytes(held[at : at + width]), length, _docs_of(ids, at, at + width)
                    at += width
                if at:
                    del held[:at]
                    ids = [(d, e - at) for d, e in ids if e > at]
    if held:
        n = len(held) // 2
        yield bytes(held) + close * (length - n), n, _docs_of(ids, 0, len(held))


def _partition_of(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, Iterator[pa.RecordBatch]]:
    """The input partition's number, from its first row, and all its batches."""
    for batch in batches:
        if batch.num_rows:
            return batch["part"][0].as_py(), chain([batch], batches)
    return None, iter(())


def _docs_of(ids: list, a: int, b: int) -> list:
    """Documents with tokens in [a, b)."""
    out, begin = [], 0
    for doc, end in ids:
        if end > a and begin < b:
            out.append(doc)
        begin = end
    return out


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def materialize(docs: DataFrame, out_dir: str, ranks: str = RANKS, end: int = END, length: int = LENGTH, key: int = 6, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every document's tokens to shards under ``out_dir`` and return what lies where.

    Returns one row per sequence: (slot, shard, record, sequence, n_tokens, doc_ids, sha256);
    n_tokens counts before padding, doc_ids are the documents with tokens in it in order (the
    end-of-text token belongs to its document), sha256 is of the record's bytes. Shards are
    written when the result is evaluated: each to a file of its own and then renamed, so a
    repeated task leaves the same shard. A null or empty text has no tokens and appears in no
    sequence; a null doc_id appears as null; repeated rows are written each. No documents
    give no shards. ``docs`` is read twice (count, then write) and must come from stored
    files, whose partitions are the same both times; a difference raises an error. out_dir
    must be shared by all executors. Extra columns are ignored.
    """
    spark, width = docs.sparkSession, 2 * length
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = _partition_of(batches)
        if part is not None:
            enc = tokenizer(ranks)
            tokens = 0
            for rows in batches:
                for a in range(0, rows.num_rows, TOGETHER):
                    texts = [t for t in rows["text"].slice(a, TOGETHER).to_pylist() if t]
                    tokens += enc.count(texts) + len(texts)
            n = -(-tokens // length)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    per_part = {r["part"]: r["n"] for r in rows.mapInArrow(count, "part int, n long").collect()}  # one number per input partition
    offsets, total = {}, 0
    for part in sorted(per_part):
        offsets[part] = (total, per_part[part])
        total += per_part[part]
    per_shard = max(1, shard_bytes // width)
    shared = spark.sparkContext.broadcast(offsets)
    cut_schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("sequence", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("tokens", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = _partition_of(batches)
        if part is None:
            return
        first, expected = shared.value[part]
        got, n = [], 0

        def flush() -> pa.RecordBatch:
            number = np.arange(first + n - len(got), first + n)
            slot = feistel(number, total, key)
            return pa.record_batch([pa.array(slot // per_shard), pa.array(slot), pa.array(number), pa.array([x[1] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.list_(pa.int64())), pa.array([x[0] for x in got], pa.binary())], schema=cut_schema)

        for x in _sequences(batches, ranks, length, end):
            got.append(x)
            n += 1
            if n > expected:
                break
            if len(got) == 256:
                yield flush()
                got = []
        if n != expected:
            raise ValueError(f"input partition {part} has {n} sequences, not the {expected} of the first reading: store the documents first")
        if got:
            yield flush()

    sequences = rows.mapInArrow(cut, "shard long, slot long, sequence long, n_tokens int, doc_ids array<long>, tokens binary")
    shards = max(1, -(-total // per_shard))
    # slots are dense, so the ranges are known without sampling: consecutive shards to a partition
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = sequences.repartitionById(parts, F.floor(F.col("shard") * parts / F.lit(shards)).cast("int")).sortWithinPartitions("shard", "slot")
    out_schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("record", pa.int64()), ("sequence", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        files, root = _file_system(out_dir)
        files.create_dir(root, recursive=True)
        shard, sink, temp, n = -1, None, "", 0

        def close() -> None:
            if sink is not None:
                sink.close()
                if n != min(per_shard, total - shard * per_shard):
                    raise ValueError(f"shard {shard} has {n} records")
                files.move(temp, f"{root}/{shard_name(shard)}")

        for batch in batches:
            sha = []
            for s, slot, tokens in zip(batch["shard"].to_pylist(), batch["slot"].to_pylist(), batch["tokens"], strict=True):
                if s != shard:
                    close()
                    shard, n, temp = s, 0, f"{root}/.{shard_name(s)}.{uuid.uuid4().hex}"
                    sink = files.open_output_stream(temp)
                if slot != shard * per_shard + n:
                    raise ValueError(f"slot {slot} is out of place")
                record = tokens.as_py()
                sink.write(record)
                sha.append(hashlib.sha256(record).hexdigest())
                n += 1
            yield pa.record_batch([batch["slot"], batch["shard"], pa.array(np.asarray(batch["slot"]) % per_shard), batch["sequence"], batch["n_tokens"], batch["doc_ids"], pa.array(sha)], schema=out_schema)
        close()

    manifest = {"sequences": total, "length": length, "dtype": "<u2", "per_shard": per_shard, "stride": width, "key": key, "end": end}
    files, root = _file_system(out_dir)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return ranged.mapInArrow(write, "slot long, shard long, record long, sequence long, n_tokens int, doc_ids array<long>, sha256 string")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(out_dir: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, token ids) in training order from ``start`` on: one seek, then sequential reads."""
    files, root = _file_system(out_dir)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    slot, stop = start, m["sequences"] if stop is None else min(stop, m["sequences"])
    while slot < stop:
        shard, record = divmod(slot, m["per_shard"])
        with files.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(record * m["stride"])
            while slot < stop and slot // m["per_shard"] == shard:
                yield slot, np.frombuffer(f.read(m["stride"]), m["dtype"])
                slot += 1


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
