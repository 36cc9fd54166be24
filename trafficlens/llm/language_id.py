"""Language identification by prediction by partial matching over bytes.

One context tree per language: counts of every byte after every context of 0 to ORDER bytes.
A byte unseen after a context costs an escape (method C: distinct / (total + distinct)) and
is coded by the next shorter context, down to a uniform byte; without exclusions. The trees
are frozen after training, so the code length of a byte depends on its last ORDER + 1 bytes
alone: all lengths are tabulated once per gram and language, and a text's exact code length
is a sum of table look-ups, done for whole batches at once. The language of the shortest
code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.exchange import give_back

U = np.uint64
ORDER = 4
#: documents a language's tree is built from, about, and the longest of them: the bound of the training sample
TRAIN_DOCS, TRAIN_BYTES = 150, 20_000
PAD = b"\n" * ORDER
SLICE = 1 << 20
UNDETERMINED = "und"
#: texts of fewer bytes are not judged by their bits per byte
JUDGED_BYTES = 64


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


class Lookup:
    """Static map from 64-bit keys to row numbers; levels of hash tables, each holding what collided before."""

    def __init__(self, keys: np.ndarray):
        self.levels, rows, odd = [], np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(rows):
            bits = max(4, int(2 * len(rows) - 1).bit_length() + 1)
            slot = ((keys[rows] * U(odd)) >> U(64 - bits)).astype(np.int64)
            table = np.full(1 << bits, -1, np.int32)
            table[slot[::-1]] = rows[::-1]
            held = np.where(table >= 0, keys[np.maximum(table, 0)], U(0xFFFFFFFFFFFFFFFF))
            self.levels.append((U(odd), U(64 - bits), table, held))
            rows = rows[table[slot] != rows]
            odd = odd * 0xD1342543DE82EF95 + 1 | 1
            odd &= (1 << 64) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it has none."""
        out = np.full(len(keys), -1, np.int32)
        left = None
        for odd, shift, table, held in self.levels:
            k = keys if left is None else keys[left]
            slot = ((k * odd) >> shift).astype(np.int64)
            same = held[slot] == k
            if left is None:
                out[same] = table[slot[same]]
                left = np.flatnonzero(~same)
            else:
                out[left[same]] = table[slot[same]]
                left = left[~same]
            if not len(left):
                break
        return out


def grams(buf: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position from n - 1 on, as one number."""
    out = np.zeros(max(0, len(buf) - n + 1), U)
    for i in range(n):
        out = out << U(8) | buf[i : i + len(out)]
    return out


class ContextTrees:
    """Frozen code lengths (bits) for every language at once.

    gram[k]    look-up of the (k+1)-byte grams seen in any language; cost[k]: their lengths
    context[k] look-up of the k-byte contexts; escape[k]: bits of leaving them (0 if unseen)
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        bufs = {x: np.frombuffer(b"".join(PAD + t for t in texts[x]), np.uint8) for x in self.langs}
        inside = {x: np.concatenate([np.r_[np.zeros(len(PAD), bool), np.ones(len(t), bool)] for t in texts[x]]) for x in self.langs}
        n = len(self.langs)
        self.gram, self.cost, self.context, self.escape = [], [], [], []
        for k in range(order + 1):
            seen = {x: np.unique(grams(bufs[x], k + 1)[inside[x][k:]], return_counts=True) for x in self.langs}
            keys = np.unique(np.concatenate([s[0] for s in seen.values()])) if n else np.empty(0, U)
            contexts = np.unique(keys >> U(8))
            count, total, kinds = np.zeros((len(keys), n)), np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            for i, x in enumerate(self.langs):
                g, c = seen[x]
                count[np.searchsorted(keys, g), i] = c
                at = np.searchsorted(contexts, g >> U(8))
                total[:, i] = np.bincount(at, c, len(contexts))
                kinds[:, i] = np.bincount(at, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                at = np.searchsorted(contexts, keys >> U(8))
                own = np.log2((total + kinds)[at] / count)
            if k == 0:
                shorter = np.full((len(keys), n), 8.0)
            else:
                shorter = self.cost[k - 1][np.searchsorted(last, keys & U((1 << 8 * k) - 1))]
            self.gram.append(Lookup(keys))
            self.cost.append(np.where(count > 0, own, escape[at] + shorter))
            self.context.append(Lookup(contexts))
            self.escape.append(escape)
            last = keys

    def bits(self, buf: np.ndarray) -> np.ndarray:
        """Code length of each byte from position ORDER on, in every language."""
        n = len(buf) - self.order
        out = np.zeros((n, len(self.langs)))
        left = np.arange(n)
        full = grams(buf, self.order + 1)
        for k in range(self.order, -1, -1):
            key = (full if len(left) == n else full[left]) & U((1 << 8 * (k + 1)) - 1)
            row = self.gram[k].find(key)
            if len(left) == n and (row >= 0).all():
                return self.cost[k][row]
            hit = row >= 0
            out[left[hit]] += self.cost[k][row[hit]]
            left = left[~hit]
            if not len(left):
                return out
            row = self.context[k].find(key[~hit] >> U(8)) if k else np.zeros(len(left), np.int32)
            known = row >= 0
            out[left[known]] += self.escape[k][row[known]]
        out[left] += 8.0
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in every language, in slices of bounded size."""
        out = np.zeros((len(texts), len(self.langs)))
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) + len(PAD) <= SLICE):
                size += len(texts[b]) + len(PAD)
                b += 1
            buf = np.frombuffer(b"".join(PAD + t for t in texts[a:b]), np.uint8)
            length = np.array([len(t) + len(PAD) for t in texts[a:b]])
            begin = np.cumsum(length) - length
            for s in range(0, len(buf) - self.order, SLICE):
                bits = self.bits(buf[s : s + SLICE + self.order])
                at = np.arange(s + self.order, s + self.order + len(bits))
                doc = np.searchsorted(begin, at, "right") - 1
                bits[at - begin[doc] < self.order] = 0.0  # the padding itself
                starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                out[a + doc[starts]] += np.add.reduceat(bits, starts, axis=0)
            a = b
        return out


def training_texts(docs: DataFrame, per_lang: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> dict[str, list[bytes]]:
    """About ``per_lang`` texts a language (never more than twice that), chosen by a hash of doc_id among the rows to learn from; of a language that has only longer texts, their beginnings. Of equal hashes (repeated ids) the first by text are taken."""
    rows = docs.select("doc_id", "text", "lang", (F.octet_length("text") <= max_bytes).alias("short")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    counts = {r["lang"]: (r["short"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.when(F.col("short"), 1)).alias("short"), F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return {}
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 11) * F.lit(2.0**-53)
    rate = F.coalesce(*[F.when((F.col("lang") == x) & (F.col("short") | F.lit(not short)), min(1.0, per_lang / (short or n))) for x, (short, n) in sorted(counts.items())])
    out: dict[str, list[bytes]] = {x: [] for x in counts}
    chosen = rows.filter(chance < rate).select("lang", F.substring("text", 1, max_bytes).alias("text"), "doc_id", chance.alias("chance"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "doc_id", "text"))
    for r in chosen.withColumn("nth", first).filter(F.col("nth") <= 2 * per_lang).orderBy("doc_id", "text").collect():  # bounded: 2 x per_lang x max_bytes a language
        out[r["lang"]].append(r["text"].encode())
    return {x: t for x, t in out.items() if t}


def most_bits(train: dict[str, list[bytes]]) -> float:
    """Bits per byte above which a text is of none of the languages: a quarter more than 99 of 100 training texts need under trees of the other half of them, in the language that needs most."""
    limit = 0.0
    needs: dict[str, list[float]] = {}
    for half in (0, 1):
        model = ContextTrees({x: t[half::2] for x, t in train.items() if t[half::2]})
        for x in model.langs:
            judged = [t for t in train[x][1 - half :: 2] if len(t) >= JUDGED_BYTES]
            if judged:
                needs.setdefault(x, []).extend(model.code_lengths(judged).min(axis=1) / [len(t) for t in judged])
    for need in needs.values():
        limit = max(limit, 1.25 * float(np.quantile(need, 0.99)))
    return limit or float("inf")


def predictions(m: ContextTrees, texts: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits in that language of each text."""
    name, score, least = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
    if m.langs:
        bits = m.code_lengths(texts)
        share = 1.0 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
        name[letters] = np.array(m.langs, object)[bits.argmin(axis=1)[letters]]
        score[letters] = share[letters]
        least = bits.min(axis=1)
    return name, score, least


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def keep_identified(docs: DataFrame, model: ContextTrees | None = None, least: float = 0.5, most: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with a score of ``least`` or more (see identify_language).

    Texts of JUDGED_BYTES or more must also take at most ``most`` bits per byte in their language;
    for trees learned here that limit is learned too (see most_bits). Where no language can be
    learned, all texts with a letter stay.
    """
    lettered = docs.filter(has_letter(F.col("text")))
    if model is None:
        train = training_texts(docs)
        if not train:
            return lettered
        most = most_bits(train) if most is None else most
        give_back()  # the trees of the halves
        model = ContextTrees(train)
    held = docs.sparkSession.sparkContext.broadcast(model)
    model = train = None  # the broadcast is on disk: the driver needs its own copy no more
    give_back()
    limit = float("inf") if most is None else most

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 512):
                rows = part.slice(a, 512)
                texts = [x or b"" for x in rows["text"].cast(pa.binary()).to_pylist()]
                _, score, bits = predictions(held.value, texts, np.ones(rows.num_rows, bool))
                size = np.array([len(x) for x in texts])
                rows = rows.filter(pa.array((score >= least) & ((size < JUDGED_BYTES) | (bits <= limit * size))))
                if rows.num_rows:
                    yield rows

    return lettered.mapInArrow(keep, docs.schema)


def identify_language(docs: DataFrame, model: ContextTrees | None = None) -> DataFrame:
    """Language of every whole text: (doc_id, held_out, lang_pred, score).

    Trees are learned from text and non-null lang of rows whose crc32(doc_id as text) mod 3
    is not 1 (about TRAIN_DOCS texts a language); held_out marks that remainder. A prediction
    reads the text alone. ``und`` with score 0 where the text is null or has no letter, or
    nothing could be learned. score is the winner's share of 2^-bits over the languages; ties
    go to the first language by name. A null doc_id is not held out and not learned from.
    One row per input row, repeated rows included; extra columns are ignored.
    """
    if model is None:
        model = ContextTrees(training_texts(docs))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    model = None
    give_back()
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part in parts:
            for a in range(0, part.num_rows, 512):
                rows = part.slice(a, 512)
                texts = [x or b"" for x in rows["text"].cast(pa.binary()).to_pylist()]
                letters = np.array(rows["letters"].to_pylist(), bool)
                name, score, _ = predictions(m, texts, letters)
                yield pa.record_batch([rows["doc_id"], rows["held_out"], pa.array(name, pa.string()), pa.array(score)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
                       has_letter(F.col("text")).alias("letters"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
