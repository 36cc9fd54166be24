"""Word and window hashes on texts made to cancel in polynomial hashes."""

import numpy as np
import pyarrow as pa

from helpers import docs_frame
from trafficlens.llm import decontaminate, jaccard_join, substring_dedup
from trafficlens.llm.hashing import TextBlock, WORD_BASE, WORD_BASE2, sequence_hashes


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def twins(n=2048):
    """Two words that collide under every polynomial hash modulo 2^64."""
    return "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))


def block(*texts):
    t = TextBlock(pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"]))
    t.words()
    return t


def test_equal_words_only():
    rng = np.random.RandomState(1)
    words = [*twins(), *twins(512), *twins(64), *twins(16), "a" * 7, "a" * 8, "a" * 9, "a" * 16, "a" * 17, "é", "a\x00", "a", *("".join(rng.choice(list("ab"), rng.randint(1, 30))) for _ in range(500))]
    t = block(*words, *words)
    for lane in (WORD_BASE, WORD_BASE2):
        h = t.word_windows(1, lane)[0]
        assert np.array_equal(h[: len(words)], h[len(words) :])
        assert len(set(h.tolist())) == len(set(words))


def test_windows_of_two_words():
    for k in (1, 2, 3, 5, 7, 13, 64, 1000, 2048):
        one, two = (" ".join(thue_morse(2048, *x)) for x in (("x", "y"), ("y", "x")))
        t = block(one, two, one)
        h, whole = t.word_windows(k)
        seen = {}
        words = [t.text(i).split() for i in range(3)]
        for i in np.flatnonzero(whole)[:6000]:
            d, at = int(t.doc[i]), int(i - t.first[t.doc[i]])
            assert seen.setdefault(int(h[i]), words[d][at : at + k]) == words[d][at : at + k]
    assert len(sequence_hashes(np.arange(3, dtype=np.uint64), 4, 1)) == 0


def test_operators_tell_such_words_apart(spark):
    a, b = twins()
    text = "one two three four five six {} eight nine ten eleven twelve thirteen fourteen"
    docs = docs_frame(spark, [(1, text.format(a)), (2, text.format(b)), (3, a), (4, b), (5, text.format(a))])
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0, 5: 14}
    classes = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    items = spark.createDataFrame([(1, f"{a} q w r"), (2, f"{b} q w r")], "item_id long, text string")
    leaks = docs_frame(spark, [(1, f"x {a} q w r y"), (2, f"x {b} q w r y")])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(leaks, items).collect()) == [(1, 1), (2, 2)]
