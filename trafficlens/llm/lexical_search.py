"""Ranked lexical search, reversed: the documents are streamed past an inverted index of the items.

The items' terms make the index (term -> items that hold it), which is broadcast in parts of
bounded size. One reading of the texts counts, per document, its terms and the occurrences of
indexed ones; these counts are written as a table, give the corpus statistics (documents,
their terms, document frequencies) and are then streamed through the index: each document's
counts are multiplied into the items of their postings, and every item keeps a bounded heap
of its best documents per task. Heaps are merged in two steps by a ranked window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.exchange import text_parts
from trafficlens.llm.hashing import LOWER, TextBlock
from trafficlens.llm.token_output import shared_folder

TOP = 10
#: item text bytes that are broadcast at once; more items take more passes over the documents
ITEM_BYTES = 16 << 20
#: (document, item) cells and postings that are held at once
CELLS = 1 << 22
#: heaps of tasks are merged in so many groups per item first
SLOTS = 64

#: every byte but ASCII letters and digits, and those of other scripts, ends a term
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(texts: pa.ChunkedArray | pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of the texts (null: none), one after the other, and the text each stands in."""
    t = TextBlock(pa.table([pa.array(np.arange(len(texts)), pa.int64()), texts], ["doc_id", "text"]))
    t.words(~IN_TERM, hashed=False)
    size = t.ends - t.starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    kept = LOWER[t.buf[IN_TERM[t.buf]]]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), t.doc


@dataclass
class ItemIndex:
    """Postings of the items' terms: the items of term t are item[first[t]:first[t + 1]], each
    with its number of occurrences in ``often``; ``weight`` is set from the corpus."""

    ids: list
    terms: pa.LargeBinaryArray
    first: np.ndarray
    item: np.ndarray
    often: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    documents: int = 0
    length: int = 0

    @classmethod
    def of(cls, ids: list, texts: list) -> "ItemIndex":
        words, item = terms_of(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        term = np.asarray(coded.indices).astype(np.int64)
        pairs, often = np.unique(term * max(1, len(ids)) + item, return_counts=True)
        term, item = np.divmod(pairs, max(1, len(ids)))
        return cls(ids, coded.dictionary, np.searchsorted(term, np.arange(len(coded.dictionary) + 1)), item, often)

    def weigh(self, documents: int, length: int, holding: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)


def item_chunks(items: DataFrame, item_bytes: int) -> Iterator[ItemIndex]:
    """The items, in as many indexes as keep each below ``item_bytes`` of text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    for part in range(parts):
        got = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield ItemIndex.of([r["item_id"] for r in got], [r["text"] for r in got])


COUNTS = "doc_id long, n long, term binary, tf binary"


def term_counts(docs: DataFrame, index: ItemIndex) -> DataFrame:
    """(doc_id, n, term, tf): each document's number of terms, and the indexed ones among them
    with their occurrences (32-bit arrays)."""
    shared = docs.sparkSession.sparkContext.broadcast(index.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, CELLS):
                vocabulary = shared.value
                words, doc = terms_of(part["text"])
                n = np.bincount(doc, minlength=part.num_rows)
                term = np.asarray(pc.fill_null(pc.index_in(words, value_set=vocabulary), -1)).astype(np.int64)
                hit = term >= 0
                pairs, tf = np.unique(doc[hit] * np.int64(max(1, len(vocabulary))) + term[hit], return_counts=True)
                at = np.searchsorted(pairs, np.arange(part.num_rows + 1) * np.int64(max(1, len(vocabulary))))
                offsets = pa.py_buffer((4 * at).astype(np.int32))

                def binary(values: np.ndarray, offsets=offsets, rows=part.num_rows) -> pa.Array:
                    return pa.Array.from_buffers(pa.binary(), rows, [None, offsets, pa.py_buffer(values.astype(np.int32))])

                ids = part["doc_id"].combine_chunks()
                yield pa.record_batch([ids, pa.array(n, pa.int64()), binary(pairs % max(1, len(vocabulary))), binary(tf)], ["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTS)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit values of a binary column, and the row of each."""
    rows = column.to_pylist()
    size = np.array([len(x) // 4 for x in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.int32).astype(np.int64), np.repeat(np.arange(len(rows)), size)


def document_frequencies(counts: DataFrame) -> dict[int, int]:
    """Documents that hold each indexed term; one number a term of the index comes to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            here = np.bincount(_flat(batch["term"])[0], minlength=len(seen))
            here[: len(seen)] += seen
            seen = here
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["term", "df"])

    rows = counts.select("term").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


class Heaps:
    """The best documents of each item so far: score descending, then doc_id (null last)."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.ones(items, np.int64)

    def push(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        first = np.searchsorted(item[order], np.arange(self.items + 1))
        order = order[np.arange(len(order)) - first[item[order]] < self.top]
        self.item, self.score, self.doc, self.null = item[order], score[order], doc[order], null[order]
        first = np.searchsorted(self.item, np.arange(self.items + 1))
        full = np.flatnonzero(np.diff(first) == self.top)
        self.least[full] = self.score[first[full + 1] - 1]  # a document that ties with it may have a smaller id


def score_slices(index: ItemIndex, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores of some documents' rows against all items) over the whole batch."""
    items = len(index.ids)
    term, doc = _flat(batch["term"])
    tf = _flat(batch["tf"])[0]
    n = batch["n"].to_pylist()
    norm = np.array([25 + 75 * x * index.documents // max(1, index.length) for x in n], np.int64)
    value = index.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[doc]))
    width = index.first[term + 1] - index.first[term]
    work = np.zeros(len(n) + 1, np.int64)
    np.add.at(work, doc + 1, width)
    work = np.cumsum(work)
    hits = np.searchsorted(doc, np.arange(len(n) + 1))
    a = 0
    while a < len(n):
        b = min(max(a + 1, int(np.searchsorted(work, work[a] + CELLS, "right")) - 1), a + max(1, CELLS // max(1, items)), len(n))
        h = np.arange(hits[a], hits[b])
        w = width[h]
        start = np.cumsum(w) - w
        place = np.arange(int(w.sum())) - np.repeat(start - index.first[term[h]], w)
        scores = np.zeros((b - a) * items, np.int64)
        np.add.at(scores, np.repeat(doc[h] - a, w) * items + index.item[place], np.repeat(value[h], w) * index.often[place])
        yield a, scores.reshape(b - a, items)
        a = b


def best_documents(counts: DataFrame, index: ItemIndex, top: int) -> DataFrame:
    """(item, item_id, rank, doc_id, score) of the index's items."""
    shared = counts.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(len(index.ids), top)
        for batch in batches:
            ids = batch["doc_id"]
            null = np.asarray(ids.is_null())
            ids = np.asarray(pc.fill_null(ids, 0))
            for a, scores in score_slices(index, batch):
                d, i = np.nonzero(scores >= heaps.least[None])
                if len(d):
                    heaps.push(i, scores[d, i], ids[a + d], null[a + d])
        yield pa.record_batch([pa.array(heaps.item, pa.int64()), pa.array([index.ids[i] for i in heaps.item], pa.int64()),
                               pa.array(heaps.doc, pa.int64(), mask=heaps.null), pa.array(heaps.score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    kept = counts.mapInArrow(search, "item long, item_id long, doc_id long, score long").withColumn("slot", F.spark_partition_id() % SLOTS)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("item", "slot").orderBy(*order))).filter(F.col("rank") <= top)
    return (kept.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``top`` best documents of each item: (item_id, rank, doc_id, score).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Every
    row of ``items`` is an item with a list of its own, also where ids or texts repeat; each
    row of ``docs`` is a document, so repeated rows fill several ranks with equal values. Null
    and empty texts have no terms: such items get no rows, such documents no score, and they
    do not count as documents of the corpus. Ties go by ascending doc_id, null ids last; null
    item ids are returned as null. A very long text is counted in one reading and weighs in
    by its length; a very long item makes postings, no more. Empty tables give no rows. The
    counts are written beside the checkpoints, and items are held in indexes of
    ``item_bytes`` of text, each with its own reading of the documents.
    """
    spark, out = docs.sparkSession, None
    for index in item_chunks(items, item_bytes):
        path = shared_folder(spark, "term-counts")
        term_counts(docs, index).write.parquet(path)
        counts = spark.read.schema(COUNTS).parquet(path)
        corpus = counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        index.weigh(corpus[0], corpus[1] or 0, document_frequencies(counts))
        found = best_documents(counts, index, top)
        out = found if out is None else out.unionByName(found)
    return out
