"""Small document tables for the operators' tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     # names that the operators use inside
                     *[T.StructField(c, T.StringType()) for c in ("block", "bucket", "size", "uid", "part", "kind", "n", "score", "first_id", "copies")]])


def docs_frame(spark, rows, partitions=3):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)), *["clash"] * 10) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def words_of(text):
    return [] if text is None else [w.decode() for w in text.encode().split()]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, blanks, nulls, repeated rows and a long text."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randrange(1, 80)).split()
        if i % 4 == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 5 == 2 and rows:
            words = words_of(rows[rng.randrange(len(rows))][1])
            if words and i % 2:
                words[rng.randrange(len(words))] = "edited"
        sep = rng.choice([" ", "  ", "\n", "\t   "])
        rows.append((i, sep.join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "one two"), (n + 5, prose(rng, 20000, 30000)), (n + 6, "é" * 3000), (n + 6, "é" * 3000), (n + 7, rows[1][1]), (None, rows[1][1]), (None, None)]
    return rows
