"""Ranked lexical search against a plain double loop."""

import math
import random
import re
from collections import Counter

from helpers import docs_frame, prose
from trafficlens.llm.lexical_search import rank_documents

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, top):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    N, L = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        wanted, found = Counter(terms(text)), []
        for d, c, n in counts:
            m = 25 + 75 * n * N // L
            score = sum(k * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item_id, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:top])]
    return out


def corpus():
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randrange(0, 60), 80).replace("w1", "W1").replace("w2 ", "é2,") + " the") for i in range(150)]
    docs += [(200, None), (201, ""), (202, "\x00 .,;"), (203, "Ünïcode_and-words's 漢字 " * 2000), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (1000, docs[3][1]), (4, docs[5][1])]
    items = [(i, prose(rng, rng.randrange(1, 20), 80) + " the the") for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "漢字 UND und Ünïcode"), (0, "w3 w4"), (None, "w5 w5 w6"), (60, prose(rng, 3000, 90))]
    return docs, items


def frames(spark, docs, items):
    schema = "item_id long, text string, rank string, score string, item string"
    return docs_frame(spark, docs, 5), spark.createDataFrame([(*x, "clash", "clash", "clash") for x in items], schema)


def test_all_items(spark):
    docs, items = corpus()
    for item_bytes in (1 << 24, 400):
        got = [tuple(r) for r in rank_documents(*frames(spark, docs, items), item_bytes=item_bytes).collect()]
        assert sorted(got, key=str) == sorted(brute_force(docs, items, 10), key=str)


def test_fewer_documents_than_ranks_and_empty_tables(spark):
    docs, items = [(1, "a b"), (2, "a"), (3, "c")], [(1, "a b c"), (2, "z")]
    got = sorted(tuple(r) for r in rank_documents(*frames(spark, docs, items), top=2).collect())
    assert got == sorted(brute_force(docs, items, 2))
    assert rank_documents(*frames(spark, [], items)).count() == 0
    assert rank_documents(*frames(spark, docs, [])).count() == 0
    assert rank_documents(*frames(spark, [(1, None)], items)).count() == 0
