"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are compared as words (lower-cased, cut at white space and ASCII punctuation).
A window matches an item of n words if their word edit distance is at most k, ``percent`` of
n; it may then hold n - k to n + k words. Places where a window could match at all are found by
an exact count filter: a window within k edits keeps at least n - q + 1 - k q of the item's
q-word grams, and lies within n + k words. The n words from each such place and the item are then embedded by the CGK random walk
(3 n steps; at step t the symbol under the pointer is copied out, and a random bit of (t,
symbol) says whether the pointer moves), which turns k edits into few Hamming differences;
an LSH key samples coordinates of the embedding, and for each item length enough walks are
repeated that a window at the full edit distance, whether its words are replaced, dropped or
added, agrees with its item in one of them with the target recall. Places that agree are
verified by the exact edit distance to the window of best length; so are all places of items
(long ones) that would need more than MAX_WALKS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.exchange import text_parts
from trafficlens.llm.hashing import IS_SPACE, TextBlock, mix
from trafficlens.llm.language_id import Lookup

U = np.uint64
# One sampled coordinate a walk keeps items of some 100 words below MAX_WALKS; places that do
# not match at all are the count filter's work.
PERCENT, RECALL, SAMPLED = 20, 0.99, 1
#: item text bytes that are broadcast at once; a larger benchmark takes more passes over the documents
ITEM_BYTES = 16 << 20
PAIRS = 1 << 14
#: text bytes searched at once: the walks are taken for all windows of a part together
PART = 8 << 20
MAX_GRAM, MAX_WALKS = 3, 64
#: edited copies per item length and kind of edit on which the walks are counted
COPIES = 512
#: words of windows that are held at once
CELLS = 1 << 22

SEPARATOR = IS_SPACE.copy()
SEPARATOR[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


@dataclass
class Items:
    """Word hashes of benchmark items, and the index of their q-grams."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self):
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.longest = int(self.n.max(initial=0))
        self.walks = np.zeros(len(self.n), np.int64)
        # all words one after the other: a long item among short ones widens no table
        self.flat = np.concatenate([*self.words, np.zeros(1, U)])
        self.begin = np.cumsum(self.n) - self.n

    def rows(self, item: np.ndarray, width: int) -> np.ndarray:
        """The first ``width`` words of each item; what follows a shorter item's end has no meaning."""
        return self.flat[np.minimum(self.begin[item][:, None] + np.arange(width)[None], len(self.flat) - 1)]

    def in_slices(self, item: np.ndarray) -> Iterator[np.ndarray]:
        """Places of ``item``, shorter items first, in slices whose rows hold at most CELLS words."""
        order = np.argsort(self.n[item], kind="stable")
        a = 0
        while a < len(order):
            to = min(len(order), a + PAIRS)
            to = a + max(1, min(to - a, CELLS // max(1, int(self.n[item[order[to - 1]]]))))
            yield order[a:to]
            a = to

    def own_keys(self, item: np.ndarray, walk: int) -> np.ndarray:
        """LSH key of each item itself."""
        out = np.zeros(len(item), U)
        for at in self.in_slices(item):
            some = item[at]
            out[at] = self.keys(some, self.rows(some, max(1, int(self.n[some].max()))), walk, self.n[some])
        return out

    def prepare(self, percent: int, recall: float, sampled: int) -> "Items":
        n = self.n
        self.k = n * percent // 100
        self.q = np.clip((n - self.k) // (self.k + 1), 1, MAX_GRAM)
        self.least = n - self.q + 1 - self.k * self.q
        self.grams = {}
        for q in sorted(set(self.q[n > 0].tolist())):
            item = np.concatenate([np.full(n[i] - q + 1, i) for i in np.flatnonzero((self.q == q) & (n > 0))])
            offset = np.concatenate([np.arange(n[i] - q + 1) for i in np.flatnonzero((self.q == q) & (n > 0))])
            key = gram_hash(self.flat[(self.begin[item] + offset)[:, None] + np.arange(q)[None]])
            order = np.argsort(key, kind="stable")
            key, item, offset = key[order], item[order], offset[order]
            distinct, first = np.unique(key, return_index=True)
            self.grams[q] = (Lookup(distinct), first, np.r_[first[1:], len(key)], item, offset)
        self.sampled = sampled
        self.walks = self._walks(recall)
        self.item_keys = []
        for walk in range(int(self.walks.max(initial=0))):
            key, need = np.zeros(len(n), U), np.flatnonzero(self.walks > walk)
            key[need] = self.own_keys(need, walk)
            self.item_keys.append(key)
        return self

    def _copies(self, rng: np.random.RandomState, item: np.ndarray, n: int, k: int) -> np.ndarray:
        """The n words from the start of a copy at distance k of each item, for four kinds of edits
        (all replaced, added and dropped alike, all dropped, all added): (kind, copy, word)."""
        half = k // 2
        out = np.empty((4, len(item), n), U)
        for kind, (added, dropped) in enumerate(((0, 0), (half, half), (0, k), (k, 0))):
            place = rng.random_sample((len(item), n)).argsort(axis=1).argsort(axis=1)
            gone = place < dropped
            twice = (place >= dropped) & (place < dropped + added)
            replaced = (place >= dropped + added) & (place < k)
            to = np.cumsum(1 + twice - gone, axis=1) - 1
            row, at = np.nonzero(~gone & ~replaced & (to < n))
            out[kind] = rng.randint(1 << 62, size=(len(item), n), dtype=np.int64).astype(U)
            out[kind, row, to[row, at]] = self.flat[self.begin[item[row]] + at]
        return out

    def _walks(self, recall: float) -> np.ndarray:
        """Walks of each item: as many as find the target share of edited copies at the full distance, for its length and each kind of edit; 0 where that takes more than MAX_WALKS, or the copies would not fit in CELLS words."""
        rng = np.random.RandomState(8)
        walks = np.ones(len(self.n), np.int64)
        lengths = np.unique(self.n[self.k > 0])
        longest = CELLS // (4 * COPIES)
        walks[(self.n > longest) & (self.k > 0)] = 0
        lengths = lengths[lengths <= longest].tolist()
        allowed = (1 - recall) / 2  # of the copies; leaves room for their chance
        while lengths:
            some = max(1, CELLS // (4 * COPIES * lengths[0]))
            group, lengths = lengths[:some], lengths[some:]
            picked = [np.resize(rng.permutation(np.flatnonzero(self.n == n)), COPIES) for n in group]
            window = np.zeros((len(group) * 4 * COPIES, group[-1]), U)
            for g, (n, item) in enumerate(zip(group, picked, strict=True)):
                window[g * 4 * COPIES : (g + 1) * 4 * COPIES, :n] = self._copies(rng, item, n, int(self.k[item[0]])).reshape(-1, n)
            item = np.concatenate([np.tile(x, 4) for x in picked])
            size, missed = self.n[item], np.ones(len(item), bool)
            of = np.repeat(np.arange(len(group)), 4 * COPIES)
            need = np.zeros(len(group), np.int64)
            open_ = np.ones(len(group), bool)
            for walk in range(MAX_WALKS):
                left = np.flatnonzero(missed & open_[of])
                if not len(left):
                    break
                agree = self.keys(item[left], window[left], walk, size[left]) == self.own_keys(item[left], walk)
                missed[left[agree]] = False
                share = missed.reshape(len(group), 4, COPIES).mean(axis=2).max(axis=1)
                done = open_ & (share <= allowed)
                need[done] = walk + 1
                open_ &= ~done
                if walk >= MAX_WALKS // 4:  # each further walk finds no larger part of the rest than those before did
                    open_ &= share ** (MAX_WALKS / (walk + 1)) <= 4 * allowed
            for n, w in zip(group, need.tolist(), strict=True):
                walks[(self.n == n) & (self.k > 0)] = w
        return walks

    def keys(self, item: np.ndarray, window: np.ndarray, walk: int, size: np.ndarray) -> np.ndarray:
        """LSH key of each window under one CGK walk; its coordinates are drawn per item length."""
        n = self.n[item]
        rng = np.random.RandomState(1000 + walk)
        share = np.sort(rng.random_sample(self.sampled))
        at = np.floor(share[None, :] * (2 * n[:, None])).astype(np.int64)  # the walk reaches a text's end after about 2 n of its 3 n steps
        pointer, key = np.zeros(len(item), np.int64), np.zeros(len(item), U)
        rows = np.arange(len(item))
        for step in range(int(at.max(initial=-1)) + 1):
            inside = pointer < size
            symbol = np.where(inside, window[rows, np.minimum(pointer, window.shape[1] - 1)], U(0))
            here = (at == step).sum(axis=1)
            for _ in range(int(here.max(initial=0))):
                key = np.where(here > 0, mix(key ^ symbol, step + 1), key)
                here = here - 1
            bit = (mix(symbol, (walk << 20) + step + 7) & U(1)).astype(np.int64)
            pointer = pointer + np.where(inside, bit, 0)
        return key


def gram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes."""
    out = np.zeros(len(words), U)
    for i in range(words.shape[1]):
        out = mix(out ^ words[:, i], 77 + i)
    return out


def edit_distance(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, most: int) -> np.ndarray:
    """Word edit distance of each pair of rows (a padded row has na words), exact up to ``most``."""
    last, off = (nb - na + most)[:, None], np.arange(2 * most + 1)
    return _nearest(a, na, b, nb, most, off[None] == last)[0]


def nearest_beginning(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``b`` the beginning nearest to the row of ``a`` (of equally near ones the
    shortest): (word edit distance, its words), exact up to ``most``."""
    size = na[:, None] + np.arange(-most, most + 1)[None]
    return _nearest(a, na, b, nb, most, (size >= 0) & (size <= nb[:, None]))


def _nearest(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, most: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of each row of ``a`` to a beginning of the row of ``b`` that is na - most ..
    na + most words long and marked in ``ends``, and the length of that beginning."""
    off = np.arange(-most, most + 1)  # row i of the table holds the columns i - most .. i + most
    far = a.shape[1] + b.shape[1] + 1
    row = np.broadcast_to(np.where(off < 0, far, off), (len(a), len(off))).astype(np.int32)
    end = np.zeros((len(a), most), U)
    wide = np.concatenate([end, b, end, np.zeros((len(a), max(0, a.shape[1] - b.shape[1])), U)], axis=1)
    out, size = np.full(len(a), far, np.int64), np.zeros(len(a), np.int64)

    def close(done: np.ndarray) -> None:
        least = np.where(ends[done], row[done], far)
        at = least.argmin(axis=1)
        out[done], size[done] = least[np.arange(len(done)), at], na[done] + at - most

    close(np.flatnonzero(na == 0))
    for i in range(1, a.shape[1] + 1):
        new = row + (wide[:, i - 1 : i + 2 * most] != a[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new[:, i + off < 0] = far
        new[:, i + off == 0] = i
        row = np.minimum.accumulate(new - off.astype(np.int32), axis=1) + off.astype(np.int32)
        close(np.flatnonzero(na == i))
    return out, size


def _hits(t: TextBlock, items: Items, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, item, word position - offset in the item) of every q-gram that an item has, and its position."""
    n = len(t.hash) - q + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e, e
    key = np.zeros(n, U)
    for i in range(q):
        key = mix(key ^ t.hash[i : i + n], 77 + i)
    find, first, last, item, offset = items.grams[q]
    row = find.find(key)
    at = np.flatnonzero((row >= 0) & (t.doc[:n] == t.doc[q - 1 :]))
    row = row[at]
    count = last[row] - first[row]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    entry = np.repeat(first[row], count) + nth
    position = np.repeat(at, count)
    return t.doc[position].astype(np.int64), item[entry], position - offset[entry], position


def _windows(t: TextBlock, items: Items, doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Distinct (doc, item, start) of the places in their text, clipped at its start, that leave room for a window."""
    start = np.maximum(start, t.first[doc])
    fits = t.first[doc + 1] - start >= np.maximum(1, items.n[item] - items.k[item])
    return np.unique(np.stack([doc, item, start])[:, fits], axis=1)


def _verify(t: TextBlock, items: Items, found: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Embed, sample and compare what starts at each place; keep each (doc, item)'s best (distance, first word, words)."""
    for at in items.in_slices(found[1]):
        doc, item, start = found[:, at]
        n, k = items.n[item], items.k[item]
        size = np.minimum(n + k, t.first[doc + 1] - start)
        span = np.arange(int((n + k).max()))
        window = np.where(span[None] < size[:, None], t.hash[np.minimum(start[:, None] + span[None], len(t.hash) - 1)], U(1))
        walks = items.walks[item]
        agree = walks == 0
        for walk in range(int(walks.max(initial=0))):
            left = np.flatnonzero(~agree & (walks > walk))
            if not len(left):
                break
            agree[left] = items.keys(item[left], window[left], walk, np.minimum(n, size)[left]) == items.item_keys[walk][item[left]]
        on = np.flatnonzero(agree)
        if not len(on):
            continue
        distance, words = nearest_beginning(items.rows(item[on], int(n[on].max())), n[on], window[on], size[on], int(k[on].max()))
        near = distance <= k[on]
        for i, d, w in zip(on[near].tolist(), distance[near].tolist(), words[near].tolist(), strict=True):
            key = (int(doc[i]), int(item[i]))
            best[key] = min(best.get(key, (1 << 60, 0, 0)), (d, int(start[i] - t.first[doc[i]]), w))


def leaks(t: TextBlock, items: Items, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(doc index, item index, distance, first word, words) of each document's best window of each item."""
    t.words(SEPARATOR)
    near, far_off = [], []
    for q in items.grams:
        doc, item, start, position = _hits(t, items, q)
        order = np.lexsort((position, item, doc))
        doc, item, start, position = doc[order], item[order], start[order], position[order]
        # enough grams within one window's reach: this hit and the least-1 next ones
        least = items.least[item]
        far = np.arange(len(doc)) + least - 1
        ok = far < len(doc)
        far = np.minimum(far, max(0, len(doc) - 1))
        ok &= (doc[far] == doc) & (item[far] == item) & (position[far] - position <= items.n[item] + items.k[item] - q)
        steps = np.zeros(len(doc) + 1, np.int64)  # every hit of such a stretch can place the window
        np.add.at(steps, np.flatnonzero(ok), 1)
        np.add.at(steps, far[ok] + 1, -1)
        on = np.cumsum(steps[:-1]) > 0
        doc, item, start = doc[on], item[on], start[on]
        if not len(doc):
            continue
        # the window that the gram places exactly, then those up to k words off
        wide = items.k[item]
        count = 2 * wide + 1
        shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) - np.repeat(wide, count)
        near.append(_windows(t, items, doc, item, start))
        off = shift != 0
        far_off.append(_windows(t, items, np.repeat(doc, count)[off], np.repeat(item, count)[off], (np.repeat(start, count) + shift)[off]))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for found in near:
        _verify(t, items, found, best)
    # an item found word for word needs no nearer window
    done = np.array([d * len(items.n) + i for (d, i), x in best.items() if x[0] == 0], np.int64)
    for found in far_off:
        _verify(t, items, found[:, ~np.isin(found[0] * len(items.n) + found[1], done)], best)
    return sorted((d, i, *b) for (d, i), b in best.items())


def folded(ids: pa.ChunkedArray | pa.Array, texts: pa.ChunkedArray | pa.Array) -> TextBlock:
    """The texts in lower case (all scripts), with these ids."""
    return TextBlock(pa.table([ids, pc.utf8_lower(texts)], ["doc_id", "text"]))


def benchmark_chunks(benchmark: DataFrame, percent: int = PERCENT, recall: float = RECALL, sampled: int = SAMPLED) -> Iterator[Items]:
    """The benchmark's items, in as many parts as keep a broadcast below ITEM_BYTES of text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // ITEM_BYTES))
    for part in range(parts):
        got = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == part).orderBy("doc_id", "text").collect()
        t = folded(pa.array([r["doc_id"] for r in got], pa.int64()), pa.array([r["text"] for r in got], pa.string()))
        t.words(SEPARATOR)
        words = [t.hash[a:b] for a, b in zip(t.first[:-1], t.first[1:], strict=True)]
        yield Items([int(i) if k else None for i, k in zip(t.ids, t.known, strict=True)], words).prepare(percent, recall, sampled)


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, item_id, distance, n_words, first_word, window_words).

    One row per document row and item with a window within percent of the item's words
    (rounded down, so items of up to 4 words must occur exactly), of any length that this
    allows; the nearest window, then the first, then the shortest, is reported, in words as compared. Items and texts without words, and null
    ones, match nothing; null ids are returned as null. Repeated rows are judged each. Extra
    columns are ignored. Very long texts are searched whole, PART bytes and more at a time, one
    text in one task. Empty documents or an empty benchmark give no rows.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "distance", "n_words", "first_word", "window_words")])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in benchmark_chunks(benchmark, percent, recall):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_parts(batch, PART):
                    t, it = folded(part["doc_id"], part["text"]), shared.value
                    got = [(int(t.ids[d]) if t.known[d] else None, it.ids[i], dist, int(it.n[i]), first, size) for d, i, dist, first, size in leaks(t, it, percent)]
                    if got:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], schema=schema)

        found = rows.mapInArrow(search, ", ".join(f"{f.name} long" for f in schema))
        out = found if out is None else out.unionByName(found)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item (see find_leaks)."""
    for items in benchmark_chunks(benchmark, percent, recall):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in text_parts(batch, PART):
                    t = folded(pa.array(range(part.num_rows), pa.int64()), part["text"])
                    bad = {int(t.ids[x[0]]) for x in leaks(t, shared.value, percent)}
                    keep = batch.slice(at, part.num_rows).filter(pa.array([i not in bad for i in range(part.num_rows)]))
                    at += part.num_rows
                    if keep.num_rows:
                        yield keep

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
