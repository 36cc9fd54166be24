"""Substring and byte deduplication against brute force."""

import hashlib

import pytest
from helpers import corpus, docs_frame, words_of

from trafficlens.llm import substring_dedup, suffix_dedup


def remove(sequences, window):
    """Reference: positions of each (id, sequence) covered by a window that a smaller id also holds."""
    lowest = {}
    for i, s in sequences:
        for a in range(len(s) - window + 1):
            key = tuple(s[a : a + window])
            if i is not None:
                lowest[key] = min(lowest.get(key, i), i)
    out = []
    for i, s in sequences:
        gone = [False] * len(s)
        for a in range(len(s) - window + 1):
            if i is not None and lowest[tuple(s[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("window", [13, 8])
def test_words(spark, window):
    rows = corpus()
    gone = remove([(i, words_of(t)) for i, t in rows], window)
    want = sorted(((i, len(g), sum(g), " ".join(w for w, x in zip(words_of(t), g) if not x)) for (i, t), g in zip(rows, gone)), key=repr)
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs_frame(spark, rows), window).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("width", [50, 26])
def test_bytes(spark, width):
    rows = [(i, t) for i, t in corpus(seed=2, n=40) if t is None or len(t) < 10_000]
    raw = [(i, (t or "").encode()) for i, t in rows]
    want = []
    for (i, b), g in zip(raw, remove(raw, width)):
        spans = sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g))
        want.append((i, len(b), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(b, g) if not x)).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.digest(suffix_dedup.suffix_dedup(docs_frame(spark, rows), width)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_periodic_bytes(spark):
    rows = [(1, "ab" * 100), (2, "x" + "ab" * 40 + "y"), (3, "ab" * 25), (4, "ab" * 24 + "a"), (5, "\0" * 60), (6, "\0" * 49), (7, "\0" * 55)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs_frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 80, 3: 50, 4: 0, 5: 0, 6: 0, 7: 55}


def test_empty_table(spark):
    assert substring_dedup.substring_dedup(docs_frame(spark, [])).collect() == []
    assert suffix_dedup.suffix_dedup(docs_frame(spark, [])).collect() == []


def test_window_bounds(spark):
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs_frame(spark, []), 7)
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs_frame(spark, []), 60)
