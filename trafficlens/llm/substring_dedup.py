"""Substring deduplication over word windows with difference-cover anchors.

Positions modulo 7 in {0, 1, 3} form a difference cover: for any two positions i and j
there is a shift below 7 that brings both onto cover positions. So two equal windows of 13
words, wherever they stand, share a 7-word anchor hashed at a cover position of both. Only
3 of 7 positions are hashed and exchanged; a window is extended to its 13 words and compared
only if one of its three anchors occurs in another document. Windows are compared by two
independent 64-bit hashes, both of which are sent: two different windows of N in all are taken
for equal with a chance of about N^2 / 2^129 (3e-13 for the 10^13 words of 100 TB).

The extension is by window key, never by pairs of anchors: each block sends a distinct
window once, with its smallest doc_id, so a group of copies costs one key per block.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm import exchange as X
from trafficlens.llm.hashing import WORD_BASE2, TextBlock, covered

U = np.uint64
#: a perfect difference cover modulo 7: every residue is a difference of two members
PERIOD, COVER = 7, (0, 1, 3)
WINDOW_SENT = "bucket int, block int, keys binary, more binary, docs binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _anchors(t: TextBlock, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of each anchor at a cover position."""
    width = window - PERIOD + 1
    h, whole = t.word_windows(width)
    at = np.arange(len(h)) - t.first[t.doc[: len(h)]]
    at = np.flatnonzero(whole & np.isin(at % PERIOD, COVER) & t.known[t.doc[: len(h)]])
    return at, h[at]


def _distinct(routed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether each is in two documents of the block, and each key's index."""
    order = np.argsort(routed, kind="stable")
    start, end = X.runs(routed[order])
    several = doc[order[start]] != doc[order[end - 1]] if len(start) else np.empty(0, bool)
    index = np.empty(len(order), np.int64)
    index[order] = np.repeat(np.arange(len(start)), end - start)
    return routed[order[start]], several, index


def _candidates(t: TextBlock, window: int, n_buckets: int, parts: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """Windows with a shared anchor: word index, and two independent 64-bit hashes."""
    at, h = _anchors(t, window)
    keys, _, index = _distinct(X.route(h, n_buckets), t.doc[at])
    shared = X.read_flags(parts, keys)[index]
    first, whole = t.word_windows(window)
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
    near = np.zeros(len(t.starts) + 1, np.int32)
    near[at[shared] + 1] = 1
    near = np.cumsum(near)
    i = np.arange(len(first))
    start = np.flatnonzero(whole & (near[i + PERIOD] > near[i]))
    return start, first[start], t.word_windows(window, WORD_BASE2)[0][start]


def _windows(t: TextBlock, start: np.ndarray, one: np.ndarray, two: np.ndarray, n: int):
    """Distinct candidate windows by (bucket, doc, key) with the smallest doc of each, and each window's index."""
    ids = t.ids[t.doc[start]]
    order = np.lexsort((two, one))  # stable: smaller doc_id first
    a, b = one[order], two[order]
    lead = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, np.int64)
    size = np.diff(np.r_[lead, len(order)])
    key, more, doc = a[lead], b[lead], ids[order[lead]]
    bucket = ((more >> U(32)) % U(n)).astype(np.int64)
    by = np.lexsort((key, doc, bucket))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    index = np.empty(len(order), np.int64)
    index[order] = np.repeat(rank, size)
    return key[by], more[by], bucket[by], doc[by], index


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_words, n_removed, kept_text): one row per input row, kept words joined
    by one space. Words are maximal runs of bytes other than space and \\t\\n\\v\\f\\r. Windows
    are judged on the input and never cross documents. A null text has no words. A row with a
    null doc_id is returned whole and removes nothing from others. Rows with equal doc_id do
    not remove words from each other. An empty table gives no rows; a very long text is a block
    of its own. Extra columns are ignored. ``window`` must be at least 8.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be above {PERIOD}")
    n = X.count_blocks(docs)
    blocks, nb = X.in_blocks(docs, n), X.buckets_for(n)

    def send_anchors(table: pa.Table) -> pa.Table:
        t = TextBlock(table)
        t.words()
        at, h = _anchors(t, window)
        keys, several, _ = _distinct(X.route(h, nb), t.ids[t.doc[at]])
        return X.pack_flags(table["block"][0].as_py(), keys, several)

    anchors = X.shared_keys(X.per_group(blocks, "block", send_anchors, X.PACKED), 0)

    def send_windows(table: pa.Table, answer: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"bucket": [], "block": [], "keys": [], "more": [], "docs": []}
        if table.num_rows:
            t = TextBlock(table)
            t.words()
            key, more, bucket, doc, _ = _windows(t, *_candidates(t, window, nb, X.answer_parts(answer, 0)), nb)
            for a, b in zip(*X.runs(bucket), strict=True):
                cols["bucket"].append(int(bucket[a]))
                cols["block"].append(table["block"][0].as_py())
                cols["keys"].append(key[a:b].tobytes())
                cols["more"].append(more[a:b].tobytes())
                cols["docs"].append(doc[a:b].tobytes())
        return pa.table(cols, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("docs", pa.binary())]))

    sent = X.with_answers(blocks, anchors, send_windows, WINDOW_SENT)

    def judge(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), U) for x in table["keys"]]
        key, more, doc = np.concatenate(keys), *(np.concatenate([np.frombuffer(x.as_py(), t) for x in table[c]]) for c, t in (("more", U), ("docs", np.int64)))
        order = np.lexsort((doc, more, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(order)]
        later = np.empty(len(order), bool)
        later[order] = doc[order] > np.repeat(doc[order[start]], end - start)
        out, at = [], 0
        for block, k in zip(table["block"].to_pylist(), keys, strict=True):
            out.append((block, 1, table["bucket"][0].as_py(), np.packbits(later[at : at + len(k)]).tobytes()))
            at += len(k)
        return X.answers(out)

    judged = X.per_group(sent, "bucket", judge, X.ANSWER)

    def keep(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[]] * 4, schema)
        t = TextBlock(table)
        t.words()
        start, one, two = _candidates(t, window, nb, X.answer_parts(answer, 0))
        key, _, bucket, doc, index = _windows(t, start, one, two, nb)
        later, parts = np.zeros(len(key), bool), X.answer_parts(answer, 1)
        for a, b in zip(*X.runs(bucket), strict=True):
            later[a:b] = np.unpackbits(np.frombuffer(parts[int(bucket[a])], np.uint8), count=b - a)
        gone = covered(start[later[index] | (t.ids[t.doc[start]] > doc[index])], window, len(t.starts))
        removed = np.r_[0, np.cumsum(gone)]
        n_removed = removed[t.first[1:]] - removed[t.first[:-1]]
        texts = []
        for i in range(t.n):
            words = t.text(i).split()
            texts.append(b" ".join(words if not n_removed[i] else compress(words, ~gone[t.first[i] : t.first[i + 1]])))
        return pa.table([pa.array(t.ids, mask=~t.known), np.diff(t.first), n_removed, pa.array(texts, pa.binary()).cast(pa.string())], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    return X.with_answers(blocks, anchors.unionByName(judged), keep, RESULT)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
