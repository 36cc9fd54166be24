"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are binned shares of character
classes, its words and their repetition, taken from the line itself and from the lines
before and after it; the chain adds weights for neighbouring labels. Training maximises the
likelihood of the document's label on all its lines (forward-backward, Adam). A document's
score is the length-weighted mean of its lines' marginal probability of good, calibrated by
a logistic curve on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.exchange import text_parts
from trafficlens.llm.hashing import IS_SPACE, TextBlock
from trafficlens.llm.language_id import remainder

#: labelled documents the model is fitted on, about, and the longest of them: the bound of the training sample
TRAIN_DOCS, TRAIN_BYTES = 6000, 50_000
THRESHOLD = 0.7
BINS = 8


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LETTERS_UP, LETTERS_LOW, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
CLASSES = [_class(LETTERS_UP), _class(LETTERS_LOW), _class(DIGITS), IS_SPACE, _class(b".,"), _class(b"!?"), _class(b"|"), _class(b"\"'()-:;"), _class(b"#$%&*+/<=>@[\\]^_`{}~"), np.arange(256) >= 128]
#: lower edges of the bins of a share and of a length
SHARES = np.array([1e-9, 0.01, 0.03, 0.08, 0.2, 0.45, 0.8])
LENGTHS = np.array([1, 10, 40, 100, 250, 600, 2000])
N_FEATURES = len(CLASSES) + 6


def line_features(t: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of every feature of every line, lines per document, and line lengths.

    Every document has at least one line (an empty one if its text is empty).
    """
    buf, n = t.buf, len(t.buf)
    breaks = np.flatnonzero(buf == 10)
    doc = np.searchsorted(t.offsets, breaks, "right") - 1
    starts = np.sort(np.r_[t.offsets[:-1], breaks + 1], kind="stable")
    lines = 1 + np.bincount(doc, minlength=t.n)[: t.n] if t.n else np.empty(0, np.int64)
    first = np.cumsum(lines) - lines
    owner = np.repeat(np.arange(t.n), lines)
    ends = np.r_[starts[1:], n]
    ends[first[1:] - 1] = t.offsets[1:-1]
    length = ends - starts
    size = np.maximum(length, 1)
    feats = np.zeros((len(starts), N_FEATURES), np.uint8)
    for i, c in enumerate(CLASSES):
        total = np.zeros(n + 1, np.int32)
        np.cumsum(c[buf], out=total[1:])
        feats[:, i] = np.searchsorted(SHARES, (total[ends] - total[starts]) / size, "right")
    feats[:, -6] = np.searchsorted(LENGTHS, length, "right")
    t.words()
    line = np.searchsorted(starts, t.starts, "right") - 1
    words = np.bincount(line, minlength=len(starts))
    feats[:, -5] = np.searchsorted(np.array([1, 3, 6, 12, 30, 80, 200]), words, "right")
    mean = np.bincount(line, t.ends - t.starts, len(starts)) / np.maximum(words, 1)
    feats[:, -4] = np.searchsorted(np.array([2, 3.5, 4.5, 5.5, 6.5, 8, 11]), mean, "right")
    order = np.lexsort((t.hash, line))
    again = np.r_[False, (t.hash[order][1:] == t.hash[order][:-1]) & (line[order][1:] == line[order][:-1])] if len(order) else np.empty(0, bool)
    repeats = np.bincount(line[order], again, len(starts)) / np.maximum(words, 1)
    feats[:, -3] = np.searchsorted(SHARES, repeats, "right")
    # words of the line that the document has used in an earlier line or place
    order = np.lexsort((np.arange(len(line)), t.hash, t.doc))
    used = np.r_[False, (t.hash[order][1:] == t.hash[order][:-1]) & (t.doc[order][1:] == t.doc[order][:-1])] if len(order) else np.empty(0, bool)
    feats[:, -2] = np.searchsorted(np.array([0.02, 0.1, 0.25, 0.4, 0.55, 0.7, 0.9]), np.bincount(line[order], used, len(starts)) / np.maximum(words, 1), "right")
    sums = np.r_[np.uint64(0), np.cumsum(t.hash)]
    lo, hi = np.searchsorted(t.starts, starts), np.searchsorted(t.starts, ends)
    text = sums[hi] - sums[lo]
    order = np.lexsort((text, owner))
    same = np.r_[False, (text[order][1:] == text[order][:-1]) & (owner[order][1:] == owner[order][:-1])] if len(order) else np.empty(0, bool)
    feats[order, -1] = same & (words[order] > 0)
    return feats, lines, length


def neighbourhood(feats: np.ndarray, lines: np.ndarray) -> list[np.ndarray]:
    """Own, previous and next line's bins; BINS marks that there is no such line."""
    first = np.cumsum(lines) - lines
    before, after = np.full_like(feats, BINS), np.full_like(feats, BINS)
    before[1:], after[:-1] = feats[:-1], feats[1:]
    before[first], after[first + lines - 1] = BINS, BINS
    return [feats, before, after]


class Crf:
    """weight[place, feature, bin]: evidence for good; link[a, b]: from label a to b."""

    def __init__(self):
        self.weight = np.zeros((3, N_FEATURES, BINS + 1))
        self.bias, self.link, self.curve = 0.0, np.zeros((2, 2)), (1.0, 0.0)

    def evidence(self, around: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(around[0]), self.bias)
        for w, f in zip(self.weight, around, strict=True):
            for i in range(N_FEATURES):
                out += w[i][f[:, i]]
        return out

    def marginals(self, evidence: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and for each line the four probabilities of (its label, the next line's)."""
        first = np.cumsum(lines) - lines
        order = np.argsort(-lines, kind="stable")  # at step t the first few chains still run
        first, lines = first[order], lines[order]
        emit = np.stack([np.zeros(len(evidence)), np.clip(evidence, -50, 50)], axis=1)
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        link = np.exp(self.link - self.link.max())
        ahead, back = np.ones((len(evidence), 2)), np.ones((len(evidence), 2))
        longest = int(lines[0]) if len(lines) else 0
        running = len(lines) - np.searchsorted(lines[::-1], np.arange(longest), "right")
        for step in range(longest):
            at = first[: running[step]] + step
            a = emit[at] if step == 0 else (ahead[at - 1] @ link) * emit[at]
            ahead[at] = a / a.sum(axis=1, keepdims=True)
        for step in range(longest - 2, -1, -1):
            at = first[: running[step + 1]] + step
            b = (back[at + 1] * emit[at + 1]) @ link.T
            back[at] = b / b.sum(axis=1, keepdims=True)
        p = ahead * back
        p = p[:, 1] / p.sum(axis=1)
        pairs = np.zeros((len(evidence), 4))
        has_next = np.ones(len(evidence), bool)
        has_next[first + lines - 1] = False
        at = np.flatnonzero(has_next)
        both = (ahead[at][:, :, None] * link[None] * (emit[at + 1] * back[at + 1])[:, None, :]).reshape(-1, 4)
        pairs[at] = both / both.sum(axis=1, keepdims=True)
        return p, pairs

    def fit(self, feats: np.ndarray, lines: np.ndarray, length: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> "Crf":
        if not len(label) or label.min() == label.max():
            self.bias = 0.0 if not len(label) else 4.0 * (2 * float(label[0]) - 1)
            return self
        around = neighbourhood(feats, lines)
        y = np.repeat(label, lines).astype(float)
        share = np.repeat(1.0 / lines, lines)  # every document weighs the same
        m = v = 0.0
        for step in range(1, steps + 1):
            p, pairs = self.marginals(self.evidence(around), lines)
            d = share * (p - y)
            g = np.zeros_like(self.weight)
            for k, f in enumerate(around):
                for i in range(N_FEATURES):
                    g[k, i] = np.bincount(f[:, i], d, BINS + 1)
            truth = np.zeros_like(pairs)
            has_next = pairs.sum(axis=1) > 0
            truth[has_next, (3 * y[has_next]).astype(int)] = 1.0
            grad = np.r_[g.ravel(), d.sum(), ((pairs - truth) * share[:, None]).sum(axis=0)] / len(label)
            w = np.r_[self.weight.ravel(), self.bias, self.link.ravel()]
            grad += l2 * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            self.weight, self.bias, self.link = w[: g.size].reshape(g.shape), w[g.size], w[g.size + 1 :].reshape(2, 2)
        x = _logit(self.document_scores(feats, lines, length, raw=True))
        a, b = 1.0, 0.0
        for _ in range(500):
            e = 1 / (1 + np.exp(-(a * x + b))) - label
            a, b = max(1e-3, a - 0.05 * (e * x).mean()), b - 0.5 * e.mean()
        self.curve = (a, b)
        return self

    def document_scores(self, feats: np.ndarray, lines: np.ndarray, length: np.ndarray, raw: bool = False) -> np.ndarray:
        p, _ = self.marginals(self.evidence(neighbourhood(feats, lines)), lines)
        first = np.cumsum(lines) - lines
        weight = length + 1.0  # an empty line counts as one byte
        mean = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first) if len(lines) else np.empty(0)
        return mean if raw else 1 / (1 + np.exp(-(self.curve[0] * _logit(mean) + self.curve[1])))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def training_sample(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, ...]:
    """Features, lines, lengths and labels of about ``n_docs`` labelled documents, chosen by a hash of doc_id. Of the rows of one doc_id, the first by a hash of the text is taken."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 4) != 2))
    n = known.count()
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) * F.lit(2.0**-53)
    chosen = known.filter(chance < (min(1.0, n_docs / n) if n else 0.0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter((F.octet_length("text") <= max_bytes) | F.col("text").isNull()).join(F.broadcast(chosen), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("nth", first).filter("nth = 1").drop("nth")  # bounded: n_docs rows, however often an id repeats

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                t = TextBlock(part)
                feats, lines, length = line_features(t)
                q = np.asarray(part["quality"])[t.order]
                yield pa.record_batch([pa.array(x, y) for x, y in (([feats.tobytes()], pa.binary()), ([lines.astype(np.int64).tobytes()], pa.binary()), ([length.astype(np.int64).tobytes()], pa.binary()), ([q.astype(np.int64).tobytes()], pa.binary()), ([t.ids.astype(np.int64).tobytes()], pa.binary()))], ["feats", "lines", "length", "quality", "ids"])

    got = rows.mapInArrow(extract, "feats binary, lines binary, length binary, quality binary, ids binary").collect()  # bounded: n_docs x max_bytes
    docs_of = []
    for r in got:
        feats, lines = np.frombuffer(r["feats"], np.uint8).reshape(-1, N_FEATURES), np.frombuffer(r["lines"], np.int64)
        length, q, ids = (np.frombuffer(r[c], np.int64) for c in ("length", "quality", "ids"))
        end = np.cumsum(lines)
        docs_of += [(int(i), feats[e - k : e], length[e - k : e], int(y)) for i, e, k, y in zip(ids, end, lines, q, strict=True)]
    docs_of.sort(key=lambda x: (x[0], x[3], x[2].tolist()))  # the same order in every run
    if not docs_of:
        return np.zeros((0, N_FEATURES), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x[1] for x in docs_of]), np.array([len(x[1]) for x in docs_of]), np.concatenate([x[2] for x in docs_of]), np.array([x[3] for x in docs_of])


def score_quality(docs: DataFrame, labels: DataFrame, model: Crf | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Quality of every whole text: (doc_id, held_out, score, predicted).

    The model is fitted on about TRAIN_DOCS documents of ``labels`` whose crc32(doc_id as
    text) mod 4 is not 2; held_out marks that remainder (false for a null doc_id). The text
    is the only input of a score. An empty or null text is one empty line and is scored like
    any other. predicted is 1 if score >= threshold. Labels that are null, repeated (the
    larger counts) or without a document are fine; without labels of both classes the score
    is the same for all. One row per input row; extra columns are ignored.
    """
    if model is None:
        model = Crf().fit(*training_sample(docs, labels))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                t = TextBlock(part)
                feats, lines, length = line_features(t)
                yield pa.record_batch([pa.array(t.ids, mask=~t.known), pa.array(held.value.document_scores(feats, lines, length))], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
