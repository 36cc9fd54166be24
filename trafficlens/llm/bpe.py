"""Byte-level BPE encoding and decoding with a public tokenizer file, by tree concatenation.

Text is cut where the tokenizer's pattern always begins a new piece, whatever stands around:
at white space after a character that is none. What lies between two such places encodes by
itself, so each distinct stretch of a batch is encoded once. Texts longer than a part are dealt
out in parts over tasks. Where such a text offers no sure place to cut, it is cut in halves
anyway; both are encoded as if they were whole texts, and joined: the pieces around the join
are found anew in growing windows until they agree with those of both sides, and a piece that
crosses the join gets its tokens from growing windows of its halves' tokens, until the window
fits its neighbours on both sides. A row of tokens is the encoding of its bytes exactly when
every two neighbours are the encoding of theirs, so that agreement is proof. Parts are joined
in a tree, a few neighbours a round.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.exchange import released, text_parts
from trafficlens.llm.token_output import shared_folder

#: a public byte-level BPE, an example of the ``tokenizer`` parameter
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: bytes of a part; texts up to that are encoded in place
PART = 1 << 16
#: neighbours that are joined in one round of the tree
FAN = 8
#: copies of one long text are spread over so many keys
SALTS = 16
#: text bytes whose distinct stretches are found at once, bytes of those that are encoded at once
BATCH, TOGETHER = 4 << 20, 1 << 18
#: neighbouring tokens that a worker remembers
REMEMBERED = 200_000
#: bytes that the pattern can look ahead (four characters)
MARGIN = 16

# The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
BYTE_OF = {c: b for b, c in ALPHABET.items()}
_TO_CHARS = [ALPHABET[b] for b in range(256)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def solid(buf: np.ndarray) -> np.ndarray:
    """Bytes that end a character that is surely no white space: printable ASCII, or two bytes of
    scripts that have none."""
    out = (buf > 32) & (buf < 127)
    out[1:] |= (buf[1:] >= 128) & (buf[1:] < 192) & (buf[:-1] >= 0xC3) & (buf[:-1] < 0xE0)
    return out


def sure_cuts(buf: np.ndarray) -> np.ndarray:
    """Places where a piece begins in any surroundings: ASCII white space after a solid character."""
    return np.flatnonzero(SPACE[buf[1:]] & solid(buf)[:-1]) + 1


class Codec:
    """One tokenizer file: pieces, their tokens, and tokens' bytes."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        d = json.loads(spec)
        pre = d["pre_tokenizer"] or {}
        if d["model"]["type"] != "BPE" or d["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or d["model"].get("ignore_merges") or d["model"].get("dropout"):
            raise ValueError("a byte-level BPE without normalizer, prefix space or dropout is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] or any(c.isspace() for c in t["content"]) for t in d["added_tokens"]):
            raise ValueError("added tokens must not hold white space or take in what surrounds them")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        d |= {"truncation": None, "padding": None}
        self.whole = Tokenizer.from_str(json.dumps(d))
        self._model_spec = json.dumps(d | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []})
        self.special = {t["content"].encode(): t["id"] for t in d["added_tokens"]}
        self.special_ids = np.array(sorted(self.special.values()), np.uint32)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        table: dict[int, bytes] = {}
        for token, i in (d["model"]["vocab"] | {t["content"]: t["id"] for t in d["added_tokens"]}).items():
            known = all(c in BYTE_OF for c in token)
            table[i] = bytes(BYTE_OF[c] for c in token) if known else token.encode()
        tokens = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(b"".join(tokens), np.uint8)
        self.pairs: dict[tuple[int, int], bool] = {}

    @cached_property
    def model(self):
        """The merges alone, for bytes that are one piece."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self._model_spec)

    # -- tokens to bytes ----------------------------------------------------------
    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each token; none for an id that is not in the file."""
        ids = ids.astype(np.int64)
        inside = (ids >= 0) & (ids < len(self.size))
        return np.where(inside, self.size[np.where(inside, ids, 0)], 0) if len(self.size) else np.zeros(len(ids), np.int64)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes(ids)
        first = self.start[np.where(n > 0, ids.astype(np.int64), 0)]
        return self.buf[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)]

    def texts_of(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The decoded text of each list of ids; what is no UTF-8 becomes U+FFFD."""
        ends = np.cumsum(np.r_[0, self.sizes(ids)])[offsets]
        data = self.bytes_of(ids).tobytes()
        return pa.array([data[i:j].decode(errors="replace") for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.large_string()).cast(pa.string())

    # -- bytes to tokens ----------------------------------------------------------
    def merge(self, piece: bytes) -> np.ndarray:
        """Tokens of bytes that are one piece (or a part of one)."""
        return np.array(self.model.encode("".join([_TO_CHARS[b] for b in piece])).ids, np.uint32)

    def fits(self, a: int, b: int) -> bool:
        """Do tokens a, b stay as they are side by side in one piece?"""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(self.bytes_of(np.array(key)).tobytes()).tolist() == [a, b]
        return got

    def stretches(self, distinct: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of all stretches, how many each has, where each one's begin). Stretches that begin with ASCII
        white space and end with a sure other character also encode by themselves side by side, so
        they go to the tokenizer together; those at a text's edges go one by one."""
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        first, last = offsets[:-1], offsets[1:] - 1
        plain = SPACE[data[first]] & solid(data)[last]
        count = np.zeros(len(distinct), np.int64)
        edge, inner = np.flatnonzero(~plain), np.flatnonzero(plain)
        edge_ids = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([data[first[i] : last[i] + 1].tobytes().decode() for i in edge], add_special_tokens=False)]
        count[edge] = [len(x) for x in edge_ids]
        size = (last - first + 1)[inner]
        ends = np.cumsum(size)
        inner_ids, a = [], 0
        while a < len(inner):
            low = int(ends[a] - size[a])
            b = max(a + 1, int(np.searchsorted(ends, low + TOGETHER, "right")))
            of = inner[a:b]
            text = data[np.arange(int(size[a:b].sum())) - np.repeat(ends[a:b] - size[a:b] - low - first[of], size[a:b])].tobytes().decode()
            ids = np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            upto = np.cumsum(self.sizes(ids))
            at = np.searchsorted(upto, ends[a:b] - low)
            if not np.array_equal(upto[at], ends[a:b] - low):
                raise ValueError("tokens cross a sure cut")
            count[of] = np.diff(at, prepend=-1)
            inner_ids.append(ids)
            a = b
        start = np.zeros(len(distinct), np.int64)
        start[np.concatenate([edge, inner])] = np.cumsum(np.r_[0, count[edge], count[inner]])[:-1]
        flat = np.concatenate([*edge_ids, *inner_ids, np.empty(0, np.uint32)])
        return flat, count, start

    def encode_many(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, offsets of each text's)."""
        data = [x.encode() if x else b"" for x in texts.to_pylist()]
        raw = b"".join(data)
        ends = np.cumsum([len(x) for x in data], dtype=np.int64) if data else np.empty(0, np.int64)
        if not raw:
            return np.empty(0, np.uint32), np.zeros(len(data) + 1, np.int64)
        bounds = np.unique(np.concatenate([[0], ends, sure_cuts(np.frombuffer(raw, np.uint8))]))
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        flat, count, start = self.stretches(coded.dictionary)
        which = np.asarray(coded.indices)
        n = count[which]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        ids = flat[np.arange(int(total[-1])) - np.repeat(total[:-1] - start[which], n)]
        return ids, np.r_[0, total[np.searchsorted(bounds, ends)]]

    # -- parts and joins ----------------------------------------------------------
    def cut(self, text: bytes, size: int) -> list[tuple[bytes, bool]]:
        """The text in parts of at most ``size`` bytes (at least one character, or one added
        token), and whether the cut before each is a sure one."""
        buf = np.frombuffer(text, np.uint8)
        sure = sure_cuts(buf)
        added = [m.span() for m in self.special_pattern.finditer(text)] if self.special_pattern else []
        inside = np.array([a for a, _ in added], np.int64)
        edges = {x for span in added for x in span}
        out, at, hard = [], 0, True
        while len(text) - at > size:
            to, next_hard = at + size, False
            i = int(np.searchsorted(sure, to, "right")) - 1
            if i >= 0 and sure[i] > at + size // 2:
                to, next_hard = int(sure[i]), True
            else:
                while to > at + 1 and (buf[to] & 0xC0) == 0x80:
                    to -= 1
                while to < len(text) and (buf[to] & 0xC0) == 0x80:  # a character wider than the part
                    to += 1
                j = int(np.searchsorted(inside, to, "left")) - 1
                if j >= 0 and added[j][0] < to < added[j][1]:
                    to = added[j][0] if added[j][0] > at else added[j][1]
                next_hard = to in edges
            out.append((text[at:to], hard))
            at, hard = to, next_hard
        return [*out, (text[at:], hard)]

    def pieces(self, text: bytes) -> np.ndarray:
        """Where the pattern's pieces of a text without added tokens begin, and its end."""
        at = [0]
        for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(text.decode()):
            at.append(at[-1] + len(piece))  # a character of a piece stands for a byte
        return np.array(at, np.int64)

    def encode_part(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, whether each begins a piece) of a text encoded as if it stood alone."""
        ids, starts, at = [], [], 0
        spans = [m.span() for m in self.special_pattern.finditer(text)] if self.special_pattern else []
        for a, b in [*spans, (len(text), len(text))]:
            found = [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(text[at:a].decode())]
            distinct = list(dict.fromkeys(found))
            tokens = dict(zip(distinct, (np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(distinct)), strict=True))
            for p in found:
                ids.append(tokens[p])
            if a < b:
                ids.append(np.array([self.special[text[a:b]]], np.uint32))
            at = b
        for t in ids:
            begin = np.zeros(len(t), bool)
            begin[:1] = True
            starts.append(begin)
        return (np.concatenate(ids), np.concatenate(starts)) if ids else (np.empty(0, np.uint32), np.empty(0, bool))

    def join_piece(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of one piece from those of its two halves, by growing windows around the join."""
        width = 4
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            window = self.merge(self.bytes_of(np.concatenate([a[i:], b[:j]])).tobytes())
            if (i == 0 or self.fits(int(a[i - 1]), int(window[0]))) and (j == len(b) or self.fits(int(window[-1]), int(b[j]))):
                return np.concatenate([a[:i], window, b[j:]])
            width *= 2

    def join(self, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, starts) of two neighbouring texts from those of each, cut at any character."""
        (x, xs), (y, ys) = left, right
        if not len(x) or not len(y):
            return (y, ys) if not len(x) else (x, xs)
        # the left side: from the last place that what follows cannot move
        ends = np.cumsum(self.sizes(x))
        begins = ends - self.sizes(x)
        starts = np.flatnonzero(xs)
        fixed = starts[begins[starts] <= max(0, int(ends[-1]) - MARGIN)]
        keep = int(fixed[-1])
        added = np.flatnonzero(np.isin(x[keep:], self.special_ids))
        if len(added):
            keep += int(added[-1]) + 1
        tail, old = x[keep:], int(ends[-1] - begins[keep]) if keep < len(x) else 0
        # the right side: up to its first added token
        added = np.flatnonzero(np.isin(y, self.special_ids))
        limit = int(added[0]) if len(added) else len(y)
        if not len(tail) or not limit:
            return np.concatenate([x, y]), np.concatenate([xs, ys])
        y_begin = np.cumsum(self.sizes(y[:limit])) - self.sizes(y[:limit])
        y_piece = np.flatnonzero(ys[:limit])  # token index of each piece
        y_at, y_end = y_begin[y_piece], int(y_begin[-1] + self.sizes(y[limit - 1 : limit])[0])
        head, reach = self.bytes_of(tail).tobytes(), 4 * MARGIN
        while True:
            more = int(np.searchsorted(y_at, reach, "left"))
            last = more >= len(y_at)
            upto = limit if last else int(y_piece[more])
            text = head + self.bytes_of(y[:upto]).tobytes()
            found = self.pieces(text)
            if last:
                agreed, resume = len(found) - 1, limit
                break
            sure = found[(found >= old) & (found <= len(text) - MARGIN)] - old
            common = sure[np.isin(sure, y_at)]
            if len(common):
                agreed = int(np.searchsorted(found, common[0] + old))
                resume = int(y_piece[np.searchsorted(y_at, common[0])])
                break
            reach *= 2
        # tokens of the pieces found anew: those that one side has already are taken over
        t_piece = np.flatnonzero(xs[keep:])
        t_at = (begins[keep:] - begins[keep])[t_piece]
        t_bound = np.append(t_piece, len(tail))
        y_bound, y_stop = np.append(y_piece, limit), np.append(y_at, y_end)
        ids, flags = [x[:keep]], [xs[:keep]]
        for a, b in zip(found[:agreed], found[1 : agreed + 1], strict=True):
            got = None
            if b <= old:
                i = int(np.searchsorted(t_at, a))
                if i < len(t_at) and t_at[i] == a and (t_at[i + 1] if i + 1 < len(t_at) else old) == b:
                    got = tail[t_bound[i] : t_bound[i + 1]]
            elif a >= old:
                i = int(np.searchsorted(y_at, a - old))
                if i < len(y_at) and y_at[i] == a - old and y_stop[i + 1] == b - old:
                    got = y[y_bound[i] : y_bound[i + 1]]
            elif t_at[-1] == a and y_stop[1] == b - old:
                got = self.join_piece(tail[t_bound[-2] :], y[: y_bound[1]])
            if got is None:
                got = self.merge(text[a:b])
            begin = np.zeros(len(got), bool)
            begin[:1] = True
            ids.append(got)
            flags.append(begin)
        return np.concatenate([*ids, y[resume:]]), np.concatenate([*flags, ys[resume:]])

    def concatenate(self, nodes: list[tuple[np.ndarray, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """The node over neighbouring nodes (tokens, starts, sure cut before), joined pairwise."""
        while len(nodes) > 1:
            above = []
            for i in range(0, len(nodes) - 1, 2):
                (x, xs, hard), (y, ys, sure) = nodes[i], nodes[i + 1]
                above.append((*((np.concatenate([x, y]), np.concatenate([xs, ys])) if sure else self.join((x, xs), (y, ys))), hard))
            nodes = above + nodes[len(nodes) - len(nodes) % 2 :]
        return nodes[0][:2]


_codecs: dict[str, Codec] = {}


def codec(spec: bytes) -> Codec:
    """The worker's codec of a tokenizer file's bytes."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))


NODE = "key string, salt int, part long, hard boolean, ids binary, starts binary"


def _node_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "salt", "part", "hard", "ids", "starts"])


def _packed(ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype(np.uint32).tobytes(), np.packbits(starts).tobytes()


def _unpacked(ids: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.uint32)
    return ids, np.unpackbits(np.frombuffer(starts, np.uint8), count=len(ids)).astype(bool)


def encode_long(texts: DataFrame, spec, part_bytes: int) -> DataFrame:
    """(key, salt, ids) of long texts (key, salt, text): parts encoded by as many tasks, joined in a tree."""
    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, salt, text in zip(*(batch[c].to_pylist() for c in ("key", "salt", "text")), strict=True):
                parts = codec(spec.value).cut(text.encode(), part_bytes)
                for a in range(0, len(parts), 64):
                    some = parts[a : a + 64]
                    yield from _node_table([(key, salt, a + i, hard, data, b"") for i, (data, hard) in enumerate(some)]).to_batches()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, salt, part, hard, data, _ in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                yield from _node_table([(key, salt, part, hard, *_packed(*codec(spec.value).encode_part(data)))]).to_batches()

    def concatenate(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in t.schema.names), strict=True), key=lambda r: r[2])
        ids, starts = codec(spec.value).concatenate([(*_unpacked(r[4], r[5]), r[3]) for r in rows])
        key, salt, part, hard = rows[0][:4]
        return _node_table([(key, salt, part // FAN, hard, *_packed(ids, starts))])

    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "bpe-parts")
    texts.mapInArrow(cut, NODE).repartition(slots, "key", "salt", "part").mapInArrow(encode, NODE).write.parquet(path)
    nodes = spark.read.schema(NODE).parquet(path)
    parts = (nodes.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        above = nodes.withColumn("_up", F.floor(F.col("part") / FAN)).groupBy("key", "salt", "_up").applyInArrow(released(concatenate), NODE)
        path = shared_folder(spark, "bpe-nodes")
        above.write.parquet(path)
        nodes, parts = spark.read.schema(NODE).parquet(path), -(-parts // FAN)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, salt, ids in zip(*(batch[c].to_pylist() for c in ("key", "salt", "ids")), strict=True):
                ids = np.frombuffer(ids, np.uint32)
                yield pa.record_batch([pa.array([key]), pa.array([salt], pa.int32()), _lists(ids, np.array([0, len(ids)]))], ["key", "salt", "ids"])

    return nodes.select("key", "salt", "ids").mapInArrow(listed, "key string, salt int, ids array<int>")


CODED = "doc_id long, ids array<int>, text string"


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, part_bytes: int = PART, decode: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``ids`` is what the tokenizers library gives for the whole text without added special
    tokens; the strings of added tokens in a text become those tokens. Null and empty texts
    have no ids; null doc_ids stay null; every repeated row gets its own row. Texts longer than
    ``part_bytes`` are encoded in parts by several tasks (copies of one text at most SALTS
    times) and joined in a tree, so a very long text, also one without a single space, is held
    whole only as a row. An empty table gives no rows. The tokenizer file is read by the
    driver and broadcast. With ``decode`` the result also has ``text``, decoded again from the
    ids by the same tasks (see ``decode_documents``).
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.octet_length("text") > part_bytes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, BATCH):
                ids, offsets = codec(spec.value).encode_many(part["text"])
                texts = codec(spec.value).texts_of(ids, offsets) if decode else pa.nulls(part.num_rows, pa.string())
                yield pa.record_batch([part["doc_id"].combine_chunks(), _lists(ids, offsets), texts], ["doc_id", "ids", "text"])
                pa.default_memory_pool().release_unused()

    short = rows.filter(F.coalesce(~is_long, F.lit(True))).mapInArrow(encode, CODED)
    keyed = rows.filter(is_long).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    texts = keyed.select("text", "salt").distinct().select(F.sha2("text", 256).alias("key"), "salt", "text")
    long = keyed.select("doc_id", F.sha2("text", 256).alias("key"), "salt").join(encode_long(texts, spec, part_bytes), ["key", "salt"]).select("doc_id", "ids")
    return short.unionByName(decode_documents(long, tokenizer)) if decode else short.drop("text").unionByName(long)


def decode_documents(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``text``, the bytes of all tokens in turn as UTF-8 (what is not becomes
    U+FFFD); ids that the tokenizer does not have are left out, null lists give empty texts. Null
    doc_ids stay null, repeated rows are decoded each, other columns are ignored."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, lists = 0, batch["ids"]
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            while a < batch.num_rows:
                b = a + max(1, int(np.searchsorted(np.cumsum(size[a:]), BATCH // 4, "right")))
                ids = np.asarray(lists.slice(a, b - a).flatten().fill_null(-1))
                part = batch.slice(a, b - a)
                yield pa.record_batch([part["doc_id"], part["ids"], codec(spec.value).texts_of(ids, np.r_[0, np.cumsum(size[a:b])])], ["doc_id", "ids", "text"])
                a = b

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, CODED)


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
