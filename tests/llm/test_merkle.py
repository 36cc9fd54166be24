"""The Merkle manifest against a tree built in memory."""

import hashlib
import zlib

import pytest

from helpers import DOCS
from trafficlens.llm.merkle_manifest import prove
from pyspark.sql import types as T

SCHEMA = T.StructType([*[f for f in DOCS if f.name not in ("lang", "source")], T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in ("grp", "pos", "key", "level", "root")]])


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i, h):
    met = []
    for level in levels[:-1]:
        j = i ^ 1
        if j < len(level):
            met.append(level[j])
            h = H(level[j], h) if j < i else H(h, level[j])
        else:
            h = H(h)
        i >>= 1
    return h, met


def brute_force(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, text, lang, source, n in rows:
        shown = n + 1 if n is not None and d is not None and zlib.crc32(str(d).encode()) % 7 == 0 else n
        groups.setdefault(lang, []).append(((d is not None, d or 0, leaf(d, source, lang, n, text)), d, leaf(d, source, lang, shown, text)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: r[0])
    trees = [tree([r[0][2] for r in groups[x]]) for x in langs]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, x in enumerate(langs):
        for i, (key, d, shown) in enumerate(groups[x]):
            half, met = climb(trees[k], i, shown)
            root, more = climb(top, k, half)
            out.append((d, key[2], trees[k][-1][0], top[-1][0], H(*met, *more), root, root == top[-1][0]))
    return out


def frame(spark, rows, partitions=3):
    full = [(d, text, *["clash"] * 10, lang, source, n, *["clash"] * 5) for d, text, lang, source, n in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


CASES = {
    "mixed": [(i, f"text {i} é" * (i % 3), [None, "", "de", "en", "é"][i % 5 if i % 11 else 3], None if i % 6 == 0 else f"s{i}", None if i % 9 == 0 else i) for i in range(60)]
    + [(7, "again", "en", "s", 5), (7, "again", "en", "s", 5), (None, "no id", "en", "s", 5), (None, None, None, None, None), (-14, "x" * 300_000, "zz", "s", 3)],
    "one row": [(3, "alone", "en", "s", 5)],
    "one group": [(i, "t", "en", "s", 1) for i in range(5)],
    "lone leaves": [(i, "t", f"l{i}", "s", 1) for i in range(7)],
    "empty": [],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_proofs(spark, name):
    rows = CASES[name]
    got = [tuple(r)[:7] for r in prove(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)


def test_more_leaves_than_a_block(spark):
    rows = [(i * 3, f"t{i}", "en" if i % 50 else "fr", "s", i) for i in range(9000)]
    got = [tuple(r)[:7] for r in prove(frame(spark, rows, 7)).collect()]
    assert sorted(got) == sorted(brute_force(rows))
    assert {r[6] for r in got} == {True, False}
