"""Exact byte-substring deduplication with run-length compressed suffix indexes.

The corpus is cut into index shards by content: inside each window of 50 bytes the 24-byte
gram of smallest hash is its anchor, so equal windows have equal anchors and meet in the
same shard. Only stretches whose anchor occurs in a second document are sent, each distinct
stretch once per block with its smallest doc_id.

A shard joins its distinct stretches into one text, ordered by document, and builds the
Burrows-Wheeler transform of that text with 49 bytes of context (no longer order matters to
a 50-byte match): rows are sorted by the 49 bytes that follow, ties by document, and each
row holds the byte before them. Its runs of equal bytes within one context are kept as
(byte, context, head sample), the sample being the document of the run's first row. The
stretches are then streamed as patterns: a window matches 50 bytes of an earlier document if
the first run of its byte in its context interval has an earlier sample. Copies lengthen
runs and add none, so the index follows the distinct text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm import exchange as X
from trafficlens.llm.hashing import BYTE_BASE, BYTE_VALUE, SLICE, TextBlock, window_hashes
from trafficlens.llm.substring_dedup import _distinct

U = np.uint64
GRAM = 24
POSITION = U((1 << 24) - 1)
SENT = "bucket int, block int, stretches binary, lengths binary, docs binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: minima of 2, 4, 8 ... and two that overlap."""
    span = 1
    while 2 * span <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if w > span else v


def _stretches(t: TextBlock, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of windows with one anchor: first and last window start, doc index, anchor hash."""
    w = width - GRAM + 1
    # starts of whole windows of one text with a known id
    steps = np.zeros(len(t.buf) + 1, np.int8)
    last = np.maximum(t.offsets[1:] - width + 1, t.offsets[:-1])
    use = t.known & (last > t.offsets[:-1])
    steps[t.offsets[:-1][use]] += 1
    steps[last[use]] -= 1
    whole = np.cumsum(steps[:-1], dtype=np.int8).view(bool)
    out = []
    for a in range(0, max(0, len(t.buf) - width + 1), SLICE):
        part = t.buf[a : a + SLICE + width - 1]
        h = window_hashes(BYTE_VALUE[part], GRAM, BYTE_BASE)
        packed = (h & ~POSITION) | np.arange(len(h), dtype=U)
        anchor = (_sliding_min(packed, w) & POSITION).astype(np.int32)
        at = np.flatnonzero(whole[a : a + len(anchor)])
        if len(at):
            chosen = anchor[at]
            lead, end = X.runs(chosen)
            out.append((a + at[lead], a + at[end - 1], h[chosen[lead]]))
    if not out:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, U)
    first, last, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return first, last, np.searchsorted(t.offsets, first, "right") - 1, h


def _shared(t: TextBlock, width: int, nb: int, parts: dict[int, bytes]):
    """Stretches with a shared anchor, and the distinct ones as (bucket, smallest doc_id, bytes) in order."""
    first, last, doc, h = _stretches(t, width)
    keys, _, index = _distinct(X.route(h, nb), doc)
    on = np.flatnonzero(X.read_flags(parts, keys)[index])
    first, last, doc, h = first[on], last[on], doc[on], h[on]
    raw, seen, index = t.raw.tobytes(), {}, np.empty(len(on), np.int64)
    bucket = (X.route(h, nb) >> U(32)).astype(np.int64)
    for i, (a, b, d) in enumerate(zip(first.tolist(), last.tolist(), doc.tolist(), strict=True)):
        index[i] = seen.setdefault(raw[a : b + width], (len(seen), d, i))[0]  # documents ascend: the first is the smallest
    own = sorted(((int(bucket[i]), int(t.ids[d]), s, n) for s, (n, d, i) in seen.items()))
    rank = np.empty(len(own), np.int64)
    rank[[n for *_, n in own]] = np.arange(len(own))
    return first, last, doc, rank[index], own


def run_length_index(text: np.ndarray, start: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Run-compressed BWT over the windows at ``start`` (ascending by ``doc``).

    Returns the row order, each row's context number, the run heads (row numbers) and the
    document sampled at each head.
    """
    context = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, width - 1)[start + 1]).view(f"S{width - 1}").ravel()
    order = np.argsort(context, kind="stable")
    context = context[order]
    number = np.cumsum(np.r_[0, context[1:] != context[:-1]]) if len(order) else np.empty(0, np.int64)
    byte = text[start[order]]
    heads = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (byte[1:] != byte[:-1])]) if len(order) else np.empty(0, np.int64)
    return order, number, heads, doc[order[heads]]


def earlier_matches(text: np.ndarray, start: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Which windows also begin in an earlier document: streamed against the run-length index."""
    order, number, heads, sample = run_length_index(text, start, doc, width)
    byte = text[start[order]].astype(np.int64)
    # heads ascend, and rows of a context by document: the first head of (context, byte) samples the earliest document
    run_key, first = np.unique(number[heads] * 256 + byte[heads], return_index=True)
    earliest = sample[first]
    out = np.empty(len(order), bool)
    out[order] = earliest[np.searchsorted(run_key, number * 256 + byte)] < doc[order]
    return out


def suffix_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept): one row per input row, ``kept``
    being the remaining bytes (removal may split a UTF-8 character). Overlapping matches
    count; strings are judged on the input and never cross documents. A null text counts as
    empty. A row with a null doc_id is returned whole and removes nothing from others. Rows
    with equal doc_id do not remove bytes from each other. Extra columns are ignored.
    ``width`` must be at least 26 and at most 55.
    """
    if not GRAM + 2 <= width <= GRAM + 31:
        raise ValueError(f"width must be {GRAM + 2} to {GRAM + 31}")
    n = X.count_blocks(docs)
    blocks, nb = X.in_blocks(docs, n), X.buckets_for(n)

    def send_anchors(table: pa.Table) -> pa.Table:
        t = TextBlock(table)
        _, _, doc, h = _stretches(t, width)
        keys, several, _ = _distinct(X.route(h, nb), t.ids[doc])
        return X.pack_flags(table["block"][0].as_py(), keys, several)

    anchors = X.shared_keys(X.per_group(blocks, "block", send_anchors, X.PACKED), 0)

    def send_stretches(table: pa.Table, answer: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"bucket": [], "block": [], "stretches": [], "lengths": [], "docs": []}
        if table.num_rows:
            *_, own = _shared(TextBlock(table), width, nb, X.answer_parts(answer, 0))
            for a, b in zip(*X.runs(np.array([x[0] for x in own], np.int64)), strict=True):
                cols["bucket"].append(own[a][0])
                cols["block"].append(table["block"][0].as_py())
                cols["stretches"].append(b"".join(x[2] for x in own[a:b]))
                cols["lengths"].append(np.array([len(x[2]) for x in own[a:b]], np.uint8).tobytes())
                cols["docs"].append(np.array([x[1] for x in own[a:b]], np.int64).tobytes())
        return pa.table(cols, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("stretches", pa.binary()), ("lengths", pa.binary()), ("docs", pa.binary())]))

    def judge(table: pa.Table) -> pa.Table:
        best: dict[bytes, int] = {}
        sent = []
        for text, lengths, ids in zip(table["stretches"].to_pylist(), table["lengths"].to_pylist(), table["docs"].to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(lengths, np.uint8).astype(np.int64)).tolist()
            own = [text[a:b] for a, b in zip([0, *ends], ends)]
            ids = np.frombuffer(ids, np.int64).tolist()
            sent.append((own, ids))
            for s, d in zip(own, ids, strict=True):
                if d < best.get(s, d + 1):
                    best[s] = d
        distinct = sorted(best, key=best.get)
        doc = np.array([best[s] for s in distinct], np.int64)
        size = np.array([len(s) for s in distinct], np.int64)
        at = np.r_[0, np.cumsum(size)]
        text = np.frombuffer(b"".join(distinct), np.uint8)
        windows = size - width + 1
        first = np.repeat(at[:-1], windows)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(windows) - windows, windows)
        gone = earlier_matches(text, first + nth, np.repeat(doc, windows), width)
        masks = np.zeros(len(distinct), np.uint32)
        owner = np.repeat(np.arange(len(distinct)), windows)
        np.bitwise_or.at(masks, owner[gone], np.uint32(1) << nth[gone].astype(np.uint32))
        mask_of = dict(zip(distinct, masks.tolist(), strict=True))
        rows = []
        for block, (own, ids) in zip(table["block"].to_pylist(), sent, strict=True):
            bits = [mask_of[s] if best[s] == d else 0xFFFFFFFF for s, d in zip(own, ids, strict=True)]
            rows.append((block, 1, table["bucket"][0].as_py(), np.array(bits, np.uint32).tobytes()))
        return X.answers(rows)

    judged = X.per_group(X.with_answers(blocks, anchors, send_stretches, SENT), "bucket", judge, X.ANSWER)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def keep(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[]] * 5, schema)
        t = TextBlock(table)
        first, last, doc, index, own = _shared(t, width, nb, X.answer_parts(answer, 0))
        parts, masks = X.answer_parts(answer, 1), np.zeros(len(own), np.uint32)
        for a, b in zip(*X.runs(np.array([x[0] for x in own], np.int64)), strict=True):
            masks[a:b] = np.frombuffer(parts[own[a][0]], np.uint32)
        smallest = np.array([x[1] for x in own], np.int64)
        whole = t.ids[doc] > smallest[index]
        steps = np.zeros(len(t.buf) + 1, np.int32)
        steps[first[whole]] += 1  # a window is in one stretch, so starts and ends are distinct
        steps[last[whole] + width] -= 1
        part = np.flatnonzero(~whole & (masks[index] != 0))
        for j in range(width - GRAM + 1):
            on = part[((masks[index[part]] >> np.uint32(j)) & 1 == 1) & (first[part] + j <= last[part])]
            at = first[on] + j
            steps[at] += 1
            steps[at + width] -= 1
        gone = np.cumsum(steps[:-1]) > 0
        total = np.r_[0, np.cumsum(gone)]
        n_removed = total[t.offsets[1:]] - total[t.offsets[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = t.offsets[:-1][np.diff(t.offsets) > 0]
        begins[heads] = gone[heads]
        spans = np.r_[0, np.cumsum(begins)]
        n_bytes = np.diff(t.offsets)
        ends = np.r_[0, np.cumsum(n_bytes - n_removed)]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), t.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(t.raw[~gone])]).cast(pa.binary())
        return pa.table([pa.array(t.ids, mask=~t.known), n_bytes, n_removed, spans[t.offsets[1:]] - spans[t.offsets[:-1]], kept], schema)

    return X.with_answers(blocks, anchors.unionByName(judged), keep, RESULT)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
