"""Language, quality and decontamination: edge rows, held-out accuracy, brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, docs_frame, prose
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm import decontaminate, language_id, quality_crf
from trafficlens.llm.hashing import TextBlock

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "123 !!"), (5, "é"), (6, "a" * 300_000), (7, "x\n" * 5000), (7, "x\n" * 5000), (None, "the end"), (8, "\0\n\0")]


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
    assert got.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1) != F.col("held_out")).count() == 0


def test_language_edges(spark):
    model = language_id.ContextTrees({"aa": [b"the cat and the dog"] * 3, "bb": [b"der hund und die katze"] * 3})
    got = {r.doc_id: r for r in language_id.identify_language(docs_frame(spark, EDGES), model).collect()}
    assert {i for i in got if got[i].lang_pred == "und"} == {1, 2, 3, 4, 8}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].lang_pred == "aa" and got[None].held_out is False
    assert language_id.identify_language(docs_frame(spark, EDGES)).filter("lang_pred <> 'und' or score <> 0").count() == 0  # nothing to learn from
    assert language_id.identify_language(docs_frame(spark, [])).collect() == []
    kept = language_id.keep_identified(docs_frame(spark, EDGES), model)
    assert kept.columns == [f.name for f in DOCS] and {r.doc_id for r in kept.collect()} <= {None, 5, 6, 7}


def test_language_rejects_foreign_and_keeps_the_rest(spark):
    """Junk and a language not learned go; without a label all lettered texts stay; a language of long texts only is learned."""
    rng = random.Random(6)
    vocabulary = {x: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)] for x, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvwx"))}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    rows = [(i, text("ab"[i % 2] * 2, 60), "ab"[i % 2] * 2) for i in range(120)]
    odd = [(1000, text("cc", 60)), (1001, "".join(rng.choice("абвгдежзийкл0123456789{}<>") for _ in range(300)))]
    kept = {r.doc_id for r in language_id.keep_identified(docs_frame(spark, rows + odd)).collect()}
    assert kept == set(range(120))
    bare = [(i, t) for i, t, _ in rows] + [(500, "12 34"), (501, None)]
    assert {r.doc_id for r in language_id.keep_identified(docs_frame(spark, bare)).collect()} == set(range(120))
    long = rows + [(2000 + i, text("cc", 6000), "cc") for i in range(9)] + [(3000, text("cc", 50))]
    assert min(len(t) for i, t, _ in long[120:129]) > language_id.TRAIN_BYTES
    got = {r.doc_id: r.lang_pred for r in language_id.identify_language(docs_frame(spark, long)).collect()}
    assert {got[i] for i in [*range(2000, 2009), 3000]} == {"cc"} and got[0] == "aa" and got[1] == "bb"


def test_code_lengths_by_hand():
    """Slices, batches and whole texts agree with a direct walk down the trees."""
    rng = random.Random(1)
    train = {x: ["".join(rng.choice(x) for _ in range(400)).encode() for _ in range(2)] for x in ("abcd", "cdef")}
    m = language_id.ContextTrees(train, order=language_id.ORDER)
    counts = {x: {} for x in train}
    for x, texts in train.items():
        for t in texts:
            padded = language_id.PAD + t
            for i in range(len(language_id.PAD), len(padded)):
                for k in range(language_id.ORDER + 1):
                    c = counts[x].setdefault(padded[i - k : i], {})
                    c[padded[i]] = c.get(padded[i], 0) + 1

    def length(x, text):
        padded, total = language_id.PAD + text, 0.0
        for i in range(len(language_id.PAD), len(padded)):
            for k in range(language_id.ORDER, -1, -1):
                c = counts[x].get(padded[i - k : i])
                if c is None:
                    continue
                n = sum(c.values()) + len(c)
                if padded[i] in c:
                    total -= np.log2(c[padded[i]] / n)
                    break
                total -= np.log2(len(c) / n)
            else:
                total += 8
        return total

    texts = [b"abcdabcd", b"", b"zz", b"cdefab\xff", bytes(rng.randrange(97, 104) for _ in range(300))]
    want = [[length(x, t) for x in m.langs] for t in texts]
    assert np.allclose(m.code_lengths(texts), want)


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_crf.score_quality(docs, labels)
    both = got.join(labels, "doc_id").filter("held_out")
    assert both.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.93
    assert got.count() == docs.count() and got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    model = quality_crf.Crf().fit(*quality_crf.training_sample(docs, labels))
    got = quality_crf.score_quality(docs_frame(spark, EDGES), labels, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert quality_crf.score_quality(docs_frame(spark, []), labels, model).collect() == []


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality_crf.score_quality(docs_frame(spark, EDGES), empty).collect()
    assert len(got) == len(EDGES) and len({r.score for r in got}) == 1


def test_chain_marginals_by_enumeration():
    """Forward-backward equals the sum over all labelings."""
    rng = np.random.RandomState(3)
    crf = quality_crf.Crf()
    crf.link = rng.randn(2, 2)
    lines = np.array([3, 1, 4])
    u = rng.randn(8)
    p, pairs = crf.marginals(u, lines)
    at = 0
    for n in lines:
        weights = np.array([np.exp(sum(u[at + i] * (z >> i & 1) for i in range(n)) + sum(crf.link[z >> i & 1, z >> i + 1 & 1] for i in range(n - 1))) for z in range(1 << n)])
        weights /= weights.sum()
        for i in range(n):
            assert np.isclose(p[at + i], sum(w for z, w in enumerate(weights) if z >> i & 1))
            if i + 1 < n:
                assert np.allclose(pairs[at + i], [sum(w for z, w in enumerate(weights) if (z >> i & 1, z >> i + 1 & 1) == (a, b)) for a in (0, 1) for b in (0, 1)])
        at += n


BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("distance", T.StringType())])


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n, 300)) for i, n in enumerate([1, 3, 5, 9, 14, 20, 36, 59])] + [(90, None), (91, ""), (92, "... !!"), (None, prose(rng, 12, 300))]
    docs = []
    for d in range(70):
        w = prose(rng, rng.randrange(0, 90), 300).split()
        if d % 2:
            x = rng.choice([t for _, t in items if t]).split()
            for _ in range(rng.randrange(0, max(1, len(x) // 4) + 1)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = ["new"] * rng.randrange(2)
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).upper() if d % 3 else " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[5][1]), (202, items[5][1]), (202, items[5][1]), (203, items[6][1][: len(items[6][1]) // 2])]
    cut = lambda t: "".join(" " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in (t or "").lower()).split()
    want = set()
    for d, text in docs:
        w = cut(text)
        for i, t in items:
            x = cut(t)
            k = len(x) * 20 // 100
            best = min((edit(x, w[s : s + m]) for s in range(len(w)) for m in range(max(1, len(x) - k), min(len(x) + k, len(w) - s) + 1)), default=99) if x else 99
            if best <= k:
                want.add((d, i))
    bench = spark.createDataFrame([(*x, "clash") for x in items], BENCH)
    got = decontaminate.find_leaks(docs_frame(spark, docs), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) > 30
    assert sum(r.doc_id == 202 for r in got) >= 2
    clean = decontaminate.remove_leaks(docs_frame(spark, docs), bench)
    assert clean.columns == [f.name for f in DOCS]
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted(d for d, _ in docs if d is not None and d not in {x for x, _ in found})


def test_leaks_empty(spark):
    bench = spark.createDataFrame([(1, "a b c d e f", "x")], BENCH)
    assert decontaminate.find_leaks(docs_frame(spark, []), bench).collect() == []
    docs = docs_frame(spark, [(1, "a b c d e f"), (2, "z")])
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    assert [r.doc_id for r in decontaminate.remove_leaks(docs, bench).collect()] == [2]


def test_recall_of_walks():
    """Windows at an item's full edit distance still agree in some walk."""
    rng = random.Random(2)
    texts = [prose(rng, 36, 10**6) for _ in range(60)]
    t = TextBlock(pa.table([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc_id", "text"]), lower=True)
    t.words(decontaminate.SEPARATOR)
    items = decontaminate.Items(list(range(60)), [t.hash[a:b] for a, b in zip(t.first[:-1], t.first[1:])]).prepare(20, 0.99, decontaminate.SAMPLED)
    hit = 0
    for i in range(60):
        w = texts[i].split()
        for at in rng.sample(range(36), 7):
            w[at] = f"new{at}"
        d = TextBlock(pa.table([pa.array([0], pa.int64()), pa.array([" ".join(w)])], ["doc_id", "text"]), lower=True)
        hit += any(x[1] == i for x in decontaminate.leaks(d, items, 20))
    assert hit >= 54


def test_recall_per_length():
    """Of copies at the full distance, 0.99 are found for every item length, the walks being counted over a mix of lengths."""
    rng = random.Random(2)
    texts = [prose(rng, n, 10**6) for n in [*range(15, 60), 80, 100] for _ in range(4)]
    t = TextBlock(pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"]), lower=True)
    t.words(decontaminate.SEPARATOR)
    items = decontaminate.Items(list(range(len(texts))), [t.hash[a:b] for a, b in zip(t.first[:-1], t.first[1:])]).prepare(20, 0.99, decontaminate.SAMPLED)
    for n in (15, 20, 30, 42, 50, 59, 80, 100):
        for kind in ("replaced", "moved", "dropped", "added"):
            docs, want = [], []
            for _ in range(400):
                i = rng.choice(np.flatnonzero(items.n == n).tolist())
                w = texts[i].split()
                if kind == "replaced":
                    for at in rng.sample(range(n), n // 5):
                        w[at] = f"new{rng.randrange(10**9)}"
                else:
                    gone, more = {"moved": (n // 10, n // 10), "dropped": (n // 5, 0), "added": (0, n // 5)}[kind]
                    for at in sorted(rng.sample(range(n), gone), reverse=True):
                        w.pop(at)
                    for _ in range(more):
                        w.insert(rng.randrange(1, len(w)), f"new{rng.randrange(10**9)}")
                docs.append(" ".join([prose(rng, 30, 10**6), *w, prose(rng, 30, 10**6)]))
                want.append((len(want), i))
            d = TextBlock(pa.table([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], ["doc_id", "text"]), lower=True)
            found = {(x[0], x[1]) for x in decontaminate.leaks(d, items, 20)}
            assert sum(x in found for x in want) >= 0.99 * len(want), (n, kind)


def test_words_dropped_or_added_up_to_the_limit(spark):
    """An item of 20 words allows four edits, also where they are all of one kind; the fifth is too many."""
    rng = random.Random(4)
    item = prose(rng, 20, 10**6).split()
    docs, want = [], {}
    for d, n in enumerate([0, 1, 2, 3, 4, 5]):
        fewer = [w for i, w in enumerate(item) if i not in range(5, 5 + n)]
        more = item[:9] + [f"extra{j}" for j in range(n)] + item[9:]
        for doc, words in ((10 + d, fewer), (30 + d, more)):
            docs.append((doc, " ".join([prose(rng, 25, 10**6), *words, prose(rng, 25, 10**6)])))
            if n <= 4:
                want[doc] = (n, 25, len(words))
    bench = spark.createDataFrame([(1, " ".join(item), "x")], BENCH)
    got = {r.doc_id: (r.distance, r.first_word, r.window_words) for r in decontaminate.find_leaks(docs_frame(spark, docs), bench).collect()}
    assert got == want


def test_one_long_item_among_short_ones():
    """A long item costs its own words, not that many for every item; it is found too."""
    rng = random.Random(6)
    texts = [prose(rng, 12, 10**6) for _ in range(2000)] + [prose(rng, 3000, 10**6)]
    t = TextBlock(pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"]), lower=True)
    t.words(decontaminate.SEPARATOR)
    items = decontaminate.Items(list(range(len(texts))), [t.hash[a:b] for a, b in zip(t.first[:-1], t.first[1:])]).prepare(20, 0.99, decontaminate.SAMPLED)
    assert len(items.flat) == 2000 * 12 + 3000 + 1 and items.walks[-1] == 0 and items.walks[0] > 0
    docs = ["start " + texts[-1] + " end", texts[7] + " and " + texts[8], "nothing here"]
    d = TextBlock(pa.table([pa.array(range(3), pa.int64()), pa.array(docs)], ["doc_id", "text"]), lower=True)
    assert decontaminate.leaks(d, items, 20) == [(0, 2000, 0, 1, 3000), (1, 7, 0, 0, 12), (1, 8, 0, 13, 12)]


def test_banded_edit_distance():
    rng = np.random.RandomState(5)
    na = rng.randint(0, 13, 500)
    nb = np.maximum(0, na - rng.randint(0, 4, 500))
    a, b = rng.randint(0, 4, (500, 12)).astype(np.uint64), rng.randint(0, 4, (500, 12)).astype(np.uint64)
    near = rng.random_sample(500) < 0.7
    b[near] = np.where(rng.random_sample((near.sum(), 12)) < 0.8, a[near], b[near])
    want = np.array([edit(x[:m].tolist(), y[:n].tolist()) for x, m, y, n in zip(a, na, b, nb)])
    for most in (0, 1, 3, 12):
        got = decontaminate.edit_distance(a, na, b, nb, most)
        assert (got[want <= most] == want[want <= most]).all() and (got[want > most] > most).all()
        got, words = decontaminate.nearest_beginning(a, na, b, nb, most)
        for i in range(0, 500, 5):
            x, y = a[i, : na[i]].tolist(), b[i, : nb[i]].tolist()
            least = min((edit(x, y[:m]), m) for m in range(len(y) + 1))
            assert (got[i], words[i]) == least if least[0] <= most else got[i] > most


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_lookup(n):
    keys = np.unique(np.random.RandomState(n).randint(0, 1 << 40, n)).astype(np.uint64)
    look = language_id.Lookup(keys)
    assert (look.find(keys) == np.arange(len(keys))).all()
    assert (look.find(keys + np.uint64(1 << 41)) == -1).all()


def test_training_samples_are_bounded_whatever_repeats(spark):
    """20,000 rows of one doc_id, with as many texts: no more than the documented number is learned from."""
    from trafficlens.llm import language_id, quality_crf

    docs = spark.range(20_000).selectExpr("3L AS doc_id", "concat('text number ', id) AS text", "'en' AS lang").unionByName(
        spark.range(300).selectExpr("id AS doc_id", "concat('autre texte ', id) AS text", "'fr' AS lang"))
    train = language_id.training_texts(docs, per_lang=20)
    assert set(train) <= {"en", "fr"} and all(len(t) <= 40 for t in train.values()) and train["fr"]
    labels = spark.range(300).selectExpr("id AS doc_id", "cast(id % 2 as int) AS quality").unionByName(spark.range(5000).selectExpr("3L AS doc_id", "1 AS quality"))
    lines = quality_crf.training_sample(docs, labels, n_docs=10_000)[1]
    assert 0 < len(lines) <= 300
