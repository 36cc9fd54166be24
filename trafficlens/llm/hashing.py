"""Vectorised text hashing inside tasks: words, word windows and byte windows of a block of texts.

A block is the text column of an Arrow table; all its texts lie in one byte buffer. A word's
hash is a chain of bit mixers over its bytes, eight at a time, for all words together; a word
window's is put together from those of its halves, again by the mixer. There is no algebra
between the parts that texts of a special form could cancel. Each has two independent lanes
of 64 bits. Byte windows are hashed by prefix sums (a polynomial modulo 2^64), which is only
good enough to bring equal windows together for an exact comparison.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: bytes hashed at once; bounds the 64-bit temporaries
SLICE = 1 << 20

_rng = np.random.RandomState(20240229)
BYTE_VALUE = _rng.randint(1, 1 << 62, 256, dtype=np.int64).astype(U) * U(2) + U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BYTE_BASE, WORD_BASE, WORD_BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MASK = (1 << 64) - 1
#: seeds of the two lanes, an odd factor that tells the first half of a window from the second
LANES, ODD = (0x243F6A8885A308D3, 0x452821E638D01377), 0x9E3779B97F4A7C15
#: steps of eight bytes that are taken for all words together
CHAIN = 64
LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finish 64-bit values so that all bits depend on all bits."""
    h = h ^ U(seed & MASK)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up), np.cumprod(down))
    return have[0][:n], have[1][:n]


def window_hashes(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of values[i:i+k] for each i with a whole window."""
    n = len(values)
    if n < k:
        return np.empty(0, U)
    up, down = powers(base, n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of each byte span; the lanes are independent of each other."""
    size = ends - starts
    out = mix(size.astype(U), LANES[lane])
    if not len(out):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(buf) + 1, np.dtype("<u8"), padded, 0, (1,))
    on, step = np.arange(len(out)), 0
    while len(on) and step < CHAIN:
        here = eights[starts[on] + 8 * step]
        left = size[on] - 8 * step
        out[on] = mix(out[on] ^ (here & LOW_BYTES[np.minimum(left, 8)]), LANES[lane] + step)
        step += 1
        on = on[left > 8]
    for i in on:  # the few longer ones
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), LANES[lane])
    return out


def sequence_hashes(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of values[i:i+k] for each i with a whole window, from hashes of 1, 2, 4, ... values."""
    n, at, out, level, size = len(values) - k + 1, 0, None, values, 1
    if n <= 0:
        return np.empty(0, U)
    while True:
        if k & size:
            part = level[at : at + n]
            out = part if out is None else mix(out * U(ODD) ^ part, size)
            at += size
        if 2 * size > k:
            return mix(out, seed)
        level = mix(level[:-size] * U(ODD) ^ level[size:], 3 * size)
        size *= 2


class TextBlock:
    """Texts of one block, ordered by doc_id (nulls last, then by text).

    ids      doc_id of each text (0 where null), known: not null
    buf      all bytes; offsets: where each text begins, and the end
    """

    def __init__(self, table: pa.Table, lower: bool = False):
        text = table.column("text")
        if not pa.types.is_large_string(text.type):
            text = text.cast(pa.large_string())
        ids = table.column("doc_id").combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.int64())
        known = ~np.asarray(ids.is_null())
        values = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)
        order = np.lexsort((values, ~known))
        text = pc.fill_null(text, "").take(pa.array(order))
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
        self.order, self.n = order, len(order)
        self.ids, self.known = values[order], known[order]
        _, offsets, data = text.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        self.buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        self.raw = self.buf
        if lower:
            self.buf = LOWER[self.buf]

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, separator: np.ndarray = IS_SPACE, hashed: bool = True) -> None:
        """Find the words: starts, ends, doc (index) of each, first (index) of each text, hash."""
        inside = ~separator[self.buf]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(self.offsets) > 0)
        head, tail = self.offsets[full], self.offsets[full + 1] - 1
        begin[head] |= inside[head]
        end[tail] |= inside[tail]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.first))
        if hashed:
            self.hash = span_hashes(self.buf, self.starts, self.ends)
        self._second = None

    def word_windows(self, k: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text; WORD_BASE2 gives the second lane."""
        values = self.hash
        if base == WORD_BASE2:
            if self._second is None:
                self._second = span_hashes(self.buf, self.starts, self.ends, 1)
            values = self._second
        h = sequence_hashes(values, k, base)
        return h, self.doc[: len(h)] == self.doc[k - 1 :] if len(h) else np.empty(0, bool)


def order_by(keys: np.ndarray, *groups: np.ndarray) -> np.ndarray:
    """Order by the last of ``groups``, then the one before it, ..., then ``keys``. Equal keys
    of a group may come in any order. Small group numbers are sorted by counting."""
    order = np.argsort(keys)
    for g in groups:
        g = g[order]
        if len(g) and 0 <= g.min() and g.max() < 1 << 16:
            g = g.astype(np.uint16)
        order = order[np.argsort(g, kind="stable")]
    return order


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window [a, a + width), a + width <= n, for the distinct a in at."""
    steps = np.zeros(n + 1, np.int32)
    steps[at] += 1
    steps[at + width] -= 1
    return np.cumsum(steps[:-1]) > 0


@lru_cache(maxsize=4)
def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out
