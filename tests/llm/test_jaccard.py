"""Jaccard components against brute force, split classes included."""

import random

from helpers import corpus, docs_frame, prose, words_of

import corpus_pipeline
from trafficlens.llm import jaccard_join


def reference(rows):
    sets = []
    for i, t in rows:
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if t else t)
        sets.append((i, {tuple(w[a : a + 3]) for a in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 90 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), None if i is None else low[find(k)]) for k, (i, s) in enumerate(sets)), key=repr)


def near_copies(n, seed=3, words=60):
    """A base, copies with one or two changed words, chains away from it and unrelated texts."""
    rng = random.Random(seed)
    base = prose(rng, words, 5000).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(2000 + i, prose(rng, words)) for i in range(20)]
    return rows


def result(spark, rows):
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(docs_frame(spark, rows)).collect()), key=repr)


def test_corpus(spark):
    rows = corpus(seed=5, n=80)
    assert result(spark, rows) == reference(rows)


def test_near_copies(spark):
    rows = near_copies(90)
    assert result(spark, rows) == reference(rows)


def test_split_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TOGETHER", 16)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    rows = near_copies(150, words=45)
    assert result(spark, rows) == reference(rows)


def test_empty_and_one_of_each(spark):
    assert result(spark, []) == []
    rows = near_copies(30)
    want = sorted({c for _, _, c in reference(rows)})
    kept = jaccard_join.keep_one_of_each(docs_frame(spark, rows + [(None, "a b c")]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.filter("doc_id is null").count() == 1 and kept.columns == docs_frame(spark, rows).columns


def five_word_reference(rows):
    """Smallest id of each document's component at 0.8 of the distinct five-word runs, and the pairs' similarities."""
    sets = {i: {tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} for i, w in ((i, words_of(t)) for i, t in rows)}
    low, similar = {i: i for i in sets}, {}
    for _ in sets:  # smallest ids spread along the links
        for a in sets:
            for b in sets:
                if (a, b) not in similar:
                    similar[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if similar[a, b] >= 0.8:
                    low[a] = low[b] = min(low[a], low[b])
    return low, similar


def test_pipeline_drops_near_copies_of_080(spark):
    """Two words replaced, or 15 appended, of 100: between 0.8 and 0.9 in five-word runs, so one document stays."""
    rng = random.Random(11)
    rows = []
    for i in range(12):
        base = prose(rng, 100, 5000).split()
        changed = list(base)
        changed[30], changed[70] = "x", "y"
        far = list(base)
        far[10], far[40], far[70] = "x", "y", "z"
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(changed)), (10 * i + 2, " ".join(base + prose(rng, 15, 5000).split())), (10 * i + 3, " ".join(far))]
    low, similar = five_word_reference(rows)
    assert sum(0.8 <= s < 0.9 for s in similar.values()) >= 48
    kept = corpus_pipeline.near_duplicates(spark, docs_frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*low.values()})


def test_five_words_080(spark):
    rows = near_copies(90, words=45)
    low, similar = five_word_reference(rows)
    assert sum(0.8 <= s < 0.9 for s in similar.values()) >= 10
    got = jaccard_join.jaccard_components(docs_frame(spark, [(i, t.lower()) for i, t in rows]), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == five_word_reference([(i, t.lower()) for i, t in rows])[0]


def test_one_of_each_by_row(spark):
    """Repeated rows, null ids and an id on two texts: one row a component stays, and no unrelated text goes."""
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 40, 5000) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, a), (3, c), (3, d), (4, c + " x"), (None, None), (0, c), (5, "")]
    kept = jaccard_join.keep_one_of_each(docs_frame(spark, rows))
    assert kept.columns == docs_frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (None, b), (0, c), (3, d), (None, None), (5, "")], key=repr)
    assert jaccard_join.keep_one_of_each(docs_frame(spark, [])).collect() == []
