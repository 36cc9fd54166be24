"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets with Jaccard similarity t or more share l tokens among the first n - ceil(t n) + l
tokens of each, under any order of all tokens. Documents with equal sets are one class. Of
the class representatives, a first order, by hash alone, keeps those that find enough of
their (about 20 % of) first tokens among the first tokens of others. The further orders put rare
tokens first (by a step of the document frequency) and break ties by hashes of their own; a
representative stays only if its share of tokens that occur elsewhere reaches t. For each, documents that share a prefix token are joined by
stars (never all pairs) into candidate classes; a link must lie within one class of every
order, so the classes are intersected before anything is verified.

Within an intersected class overlaps are counted exactly, by products of token incidence
matrices in blocks of bounded size. Classes beyond one block are split: blocks are solved
alone, their components joined through representatives, and only documents outside a class's
largest component meet the other blocks. What leaves a task is a spanning forest of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm import exchange as X
from trafficlens.llm.components import components
from trafficlens.llm.hashing import TextBlock, mix, order_by

U = np.uint64
SHINGLE, PERCENT, ORDERS = 3, 90, 3
#: documents and token bytes whose overlaps are counted at once, and columns of the incidence matrix
TOGETHER, TOGETHER_BYTES, COLUMNS = 512, 32 << 20, 8192
SHINGLE_BASE = 0xC2B2AE3D27D4EB4F


def shingle_sets(t: TextBlock, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc index, hash) of the distinct shingles, sorted; a text of fewer words has one, of all its words."""
    t.words()
    h, whole = t.word_windows(k, SHINGLE_BASE)
    docs, keys = [t.doc[: len(h)][whole]], [h[whole]]
    count = np.diff(t.first)
    for n in range(1, k):
        at = t.first[:-1][count == n]
        if len(at):
            short, _ = t.word_windows(n, SHINGLE_BASE)
            docs.append(t.doc[at])
            keys.append(mix(short[at], n))
    doc, key = np.concatenate(docs).astype(np.int64), np.concatenate(keys)
    order = order_by(key, doc)
    doc, key = doc[order], key[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])] if len(doc) else np.empty(0, bool)
    return doc[new], key[new]


def _digests(t: TextBlock, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit sums over each document's set."""
    n = np.bincount(doc, minlength=t.n)
    start = np.cumsum(n) - n
    full = n > 0
    out = []
    for seed in (11, 12):
        d = np.zeros(t.n, U)
        if full.any():
            d[full] = np.add.reduceat(mix(key, seed), start[full])
        out.append(d.view(np.int64))
    return n, out[0], out[1]


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def extended(n: np.ndarray, percent: int) -> np.ndarray:
    """l of the extended prefix: as many tokens as the plain prefix has, or all that must be common."""
    return np.minimum(need(n, percent), n - need(n, percent) + 1)


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a[:, None] + b[None, :] - inter)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the pairwise intersections, by incidence matrices over COLUMNS tokens at a time."""
    both = left + (right or [])
    size = np.array([len(x) for x in both], np.int64)
    row = np.repeat(np.arange(len(both)), size)
    _, token = np.unique(np.concatenate(both), return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    n = len(left)
    out = np.zeros((n, len(right) if right is not None else n), np.int64)
    for c in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, [c, c + COLUMNS])
        m = np.zeros((len(both), int(token[b - 1]) - c + 1), np.float32)
        m[row[a:b], token[a:b] - c] = 1.0
        out += np.rint(m[:n] @ (m[n:] if right is not None else m).T).astype(np.int64)
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """Smallest index of each vertex's component, from a symmetric boolean matrix."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each of n vertices' components, from an edge list."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _table(schema: pa.Schema, *cols) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _frequency_steps(packed: DataFrame) -> DataFrame:
    """For each packed key one byte: 0 if one document has it, else 1 + floor(3 log2(documents))."""

    def merge(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in t["keys"]]
        count = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in t["more"]]).astype(np.int64)
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        start, end = X.runs(every[by])
        total = np.add.reduceat(count[by], start)
        step = np.where(total > 1, 1 + np.floor(3 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        out = np.empty(len(by), np.uint8)
        out[by] = np.repeat(step, end - start)
        rows, at = [], 0
        for block, k in zip(t["block"].to_pylist(), keys, strict=True):
            rows.append((block, 1, t["bucket"][0].as_py(), out[at : at + len(k)].tobytes()))
            at += len(k)
        return X.answers(rows)

    return X.per_group(packed, "bucket", merge, X.ANSWER)


def candidates(blocks: DataFrame, reps: DataFrame, nb: int, shingle: int, percent: int, orders: int) -> DataFrame:
    """Rows of kinds: 'doc' (id, n, tokens that others have), 'edge' (order, packed star edges), 'entry' (bucket, order, packed prefix tokens and their smallest document)."""

    def representatives(table: pa.Table, answer: pa.Table) -> tuple[TextBlock, np.ndarray, np.ndarray, np.ndarray]:
        """The block's texts, and (doc index, token) of those that stand for their class."""
        t = TextBlock(table, lower=True)
        doc, key = shingle_sets(t, shingle)
        n, one, two = _digests(t, doc, key)
        bits = [x for p, x in zip(answer["phase"].to_pylist(), answer["bits"].to_pylist(), strict=True) if p == 0]
        wanted = {tuple(r) for x in bits for r in np.frombuffer(x, np.int64).reshape(-1, 3).tolist()}
        keep, seen = np.zeros(t.n, bool), set()
        for i, r in enumerate(zip(t.ids.tolist(), one.tolist(), two.tolist(), strict=True)):
            keep[i] = t.known[i] and n[i] > 0 and r in wanted and r not in seen
            seen.add(r)  # of repeated rows one stands
        on = keep[doc]
        return t, n, doc[on], key[on]

    def first_tokens(size: np.ndarray, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (doc index, token) of the extended prefixes under the hash order."""
        order = order_by(mix(key, 99), doc)
        doc, key = doc[order], key[order]
        start, end = X.runs(doc)
        n = size[doc[start]]
        nth = np.arange(len(doc)) - np.repeat(start, end - start)
        on = nth < np.repeat(n - need(n, percent) + extended(n, percent), end - start)
        return doc[on], key[on]

    def send_first(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.pack_flags(0, np.empty(0, U), np.empty(0, bool))
        _, size, doc, key = representatives(table, answer)
        doc, key = first_tokens(size, doc, key)
        routed = np.sort(X.route(key, nb))
        start, end = X.runs(routed)
        return X.pack_flags(table["block"][0].as_py(), routed[start], end - start > 1)

    first = X.shared_keys(X.with_answers(blocks, reps, send_first, X.PACKED), 2)
    reps = reps.unionByName(first)

    def hopeful(table: pa.Table, answer: pa.Table) -> tuple[TextBlock, np.ndarray, np.ndarray, np.ndarray]:
        """representatives(), less those that share too few of their first tokens."""
        t, size, doc, key = representatives(table, answer)
        who, token = first_tokens(size, doc, key)
        routed, index = np.unique(X.route(token, nb), return_inverse=True)
        shared = X.read_flags(X.answer_parts(answer, 2), routed)[index]
        found = np.bincount(who, shared, t.n)
        # a partner may be smaller, down to need(n), and its prefix shorter
        keep = found >= extended(need(size, percent), percent)
        return t, size, doc[keep[doc]], key[keep[doc]]

    def send(table: pa.Table, answer: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"bucket": [], "block": [], "keys": [], "more": []}
        if table.num_rows:
            _, _, _, key = hopeful(table, answer)
            routed = np.sort(X.route(key, nb))
            start, end = X.runs(routed)
            routed, count = routed[start], (end - start).astype(np.int32)
            low = routed.astype(np.uint32)
            for a, b in zip(*X.runs(routed >> U(32)), strict=True):
                cols["bucket"].append(int(routed[a] >> U(32)))
                cols["block"].append(table["block"][0].as_py())
                cols["keys"].append(low[a:b].tobytes())
                cols["more"].append(count[a:b].tobytes())
        return pa.table(cols, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())]))

    steps = _frequency_steps(X.with_answers(blocks, reps, send, X.PACKED))
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("order", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])

    def choose(table: pa.Table, answer: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            t, size, doc, key = hopeful(table, answer)
            routed = X.route(key, nb)
            distinct, index = np.unique(routed, return_inverse=True)
            parts, step = X.answer_parts(answer, 1), np.zeros(len(distinct), np.uint8)
            for a, b in zip(*X.runs(distinct >> U(32)), strict=True):
                step[a:b] = np.frombuffer(parts[int(distinct[a] >> U(32))], np.uint8)
            step = step[index]
            shared = np.bincount(doc, step > 0, t.n)
            able = (size > 0) & (shared >= need(size, percent))
            on = able[doc]
            doc, key, step = doc[on], key[on], step[on]
            place = {d: i for i, d in enumerate(np.unique(doc).tolist())}
            ids = t.ids[list(place)]
            start, end = X.runs(doc)
            n = size[doc[start]]
            for a, b, k in zip(start.tolist(), end.tolist(), n.tolist(), strict=True):
                rows.append(("doc", None, None, int(t.ids[doc[a]]), k, key[a:b][step[a:b] > 0].tobytes(), None))
            owner = np.repeat(np.arange(len(start)), end - start)
            for o in range(orders):
                rank = order_by(mix(key, 100 + o), step, owner)
                nth = np.arange(len(rank)) - np.repeat(start, end - start)
                pick = rank[(nth < np.repeat(n - need(n, percent) + 1, end - start)) & (step[rank] > 0)]
                token, who = key[pick], owner[pick]
                by = np.lexsort((who, token))
                token, who = token[by], who[by]
                first, last = X.runs(token)
                lead = np.repeat(who[first], last - first)
                label = _union(lead, who, len(start))
                apart = np.flatnonzero(label != np.arange(len(start)))
                if len(apart):
                    rows.append(("edge", None, o, None, None, ids[label[apart]].tobytes(), ids[apart].tobytes()))
                token, who = token[first], ids[label[who[first]]]
                bucket = ((token >> U(32)) % U(nb)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                token, who, bucket = token[by], who[by], bucket[by]
                for a, b in zip(*X.runs(bucket), strict=True):
                    rows.append(("entry", int(bucket[a]), o, None, None, token[a:b].tobytes(), who[a:b].tobytes()))
        return _table(schema, *(zip(*rows, strict=True) if rows else [[]] * 7))

    return X.with_answers(blocks, reps.unionByName(steps), choose, "kind string, bucket int, order int, id long, n long, x binary, y binary")


def star_edges(found: DataFrame) -> DataFrame:
    """(order, a, b) between documents that share a prefix token, a star per token."""
    schema = pa.schema([("order", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def unpack(table: pa.Table) -> pa.Table:
        out = [[], [], []]
        for o, x, y in zip(table["order"].to_pylist(), table["x"].to_pylist(), table["y"].to_pylist(), strict=True):
            out[1].append(np.frombuffer(x, np.int64))
            out[2].append(np.frombuffer(y, np.int64))
            out[0].append(np.full(len(out[1][-1]), o, np.int32))
        return _table(schema, *(np.concatenate(c) if c else [] for c in out))

    def meet(table: pa.Table) -> pa.Table:
        token, who = (np.concatenate([np.frombuffer(v, t) for v in table[c].to_pylist()]) for c, t in (("x", U), ("y", np.int64)))
        by = np.lexsort((who, token))
        token, who = token[by], who[by]
        start, end = X.runs(token)
        lead = np.repeat(who[start], end - start)
        apart = np.unique(np.stack([lead, who])[:, lead != who], axis=1)
        return _table(schema, np.full(apart.shape[1], table["order"][0].as_py(), np.int32), apart[0], apart[1])

    def local(batches):
        for batch in batches:
            yield from unpack(pa.Table.from_batches([batch])).to_batches()

    text = "order int, a long, b long"
    inside = found.filter("kind = 'edge'").select("order", "x", "y").mapInArrow(local, text)
    across = found.filter("kind = 'entry'").select("order", "bucket", "x", "y").groupBy("order", "bucket").applyInArrow(X.released(meet), text)
    return inside.unionByName(across)


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return table["id"].to_numpy(), table["n"].to_numpy(), [np.frombuffer(x, U) for x in table["x"].to_pylist()]


def solve(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smallest id of each one's component within one class (or one block of it)."""
    ids, n, sets = _members(table)
    order = np.argsort(ids, kind="stable")
    ids, n, sets = ids[order], n[order], [sets[i] for i in order]
    return ids, ids[forest(linked(overlaps(sets), n, n, percent))]


def _blocks():
    """Blocks that the grouped documents need, by their number and their tokens."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(TOGETHER)), F.ceil(F.sum(F.octet_length("x")) / F.lit(TOGETHER_BYTES))).cast("int")


def links_of_classes(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of all links within the classes of ``members`` (class, id, n, x)."""
    spark = members.sparkSession
    sizes = members.groupBy("class").agg(_blocks().alias("blocks"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = X.checkpointed(members.join(sizes, "class"))
    biggest, total, size = members.agg(F.max("blocks"), F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bundles = max(slots, -(-total // (4 * TOGETHER)), -(-size // TOGETHER_BYTES))

    def bundle(table: pa.Table) -> pa.Table:
        a, b = [], []
        by = table.sort_by([("class", "ascending")])
        names = by["class"].to_numpy()
        for s, e in zip(*X.runs(names), strict=True):
            ids, root = solve(by.slice(s, e - s), percent)
            a.append(root[root != ids])
            b.append(ids[root != ids])
        return _table(EDGE, np.concatenate(a), np.concatenate(b))

    few = members.filter("blocks = 1").withColumn("bundle", F.pmod(F.xxhash64("class"), F.lit(bundles)))
    links = X.per_group(few, "bundle", bundle, "a long, b long")
    if (biggest or 0) <= 1:
        return links
    return links.unionByName(_links_of_large(members.filter("blocks > 1"), percent))


def _links_of_large(members: DataFrame, percent: int) -> DataFrame:
    """The same for classes of more than one block."""
    members = members.withColumn("part", F.pmod(F.xxhash64("id", F.lit(21)), F.col("blocks")).cast("int"))

    def alone(table: pa.Table) -> pa.Table:
        ids, root = solve(table, percent)
        return _table(EDGE, root, ids)

    inner = X.checkpointed(members.groupBy("class", "part").applyInArrow(X.released(alone), "a long, b long"))
    # one document of each block's component, among themselves
    heads = members.join(inner.select(F.col("a").alias("id")).distinct(), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(22)), F.col("blocks")).cast("int"))
    known = X.checkpointed(inner.unionByName(heads.groupBy("class", F.floor(F.col("part") / 4).alias("part4")).applyInArrow(X.released(lambda t: alone(t)), "a long, b long")))
    root = components(known)
    labelled = members.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    largest = labelled.groupBy("class", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("class").agg(F.max(F.struct("k", "root")).alias("top")).select("class", F.col("top.root").alias("top"))
    labelled = X.checkpointed(labelled.join(largest, "class"))
    outside = labelled.filter("root <> top")
    chunks = outside.groupBy("class").agg(_blocks().alias("chunks"))
    right = outside.join(chunks, "class").select("class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit(23)), F.col("chunks")).cast("int").alias("chunk"), "id", "n", "x", "root")
    left = labelled.join(chunks, "class").select("class", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "n", "x", "root")

    def across(table: pa.Table, other: pa.Table) -> pa.Table:
        if not table.num_rows or not other.num_rows:
            return _table(EDGE, [], [])
        ids, n, sets = _members(table)
        ids2, n2, sets2 = _members(other)
        i, j = np.nonzero(linked(overlaps(sets, sets2), n, n2, percent))
        label = _union(i, j + len(ids), len(ids) + len(ids2))
        every = np.r_[ids, ids2]
        apart = np.flatnonzero(label != np.arange(len(every)))
        return _table(EDGE, every[label[apart]], every[apart])

    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # names of its own: both sides come from one table
    key = ("class", "part", "chunk")
    cross = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(X.released(across, 2), "a long, b long")
    return known.unionByName(cross).filter("a <> b")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """Components of documents linked by shingle-set similarity: (doc_id, n_shingles, component_id).

    Words are maximal runs of bytes other than space and \\t\\n\\v\\f\\r, A-Z lower-cased; a set holds the
    distinct runs of ``shingle`` words (a text of fewer words: all of them as one). Documents
    link when 100 |x & y| >= percent |x | y|; component_id is the smallest doc_id reachable.
    Texts without words, or null, have an empty set and link with nothing. A row with a null
    doc_id links with nothing and has a null component_id. Repeated rows are returned each.
    Extra columns are ignored.
    """
    n = X.count_blocks(docs)
    blocks, nb = X.in_blocks(docs, n), X.buckets_for(n)
    schema = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.text_parts(batch):
                t = TextBlock(part, lower=True)
                size, one, two = _digests(t, *shingle_sets(t, shingle))
                yield pa.record_batch([pa.array(np.asarray(part["block"])[t.order]), pa.array(t.ids, mask=~t.known), pa.array(size), pa.array(one), pa.array(two)], schema=schema)

    sets = X.checkpointed(X.block_rows(docs, n).mapInArrow(measure, "block int, doc_id long, n long, one long, two long"))
    full = sets.filter("n > 0 and doc_id is not null")
    classes = X.checkpointed(full.groupBy("one", "two", "n").agg(F.min(F.struct("doc_id", "block")).alias("rep")).select("one", "two", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.block").alias("block")))

    def list_reps(table: pa.Table) -> pa.Table:
        x = np.stack([table[c].to_numpy() for c in ("rep", "one", "two")], axis=1).astype(np.int64)
        return X.answers([(table["block"][0].as_py(), 0, 0, np.ascontiguousarray(x).tobytes())])

    reps = X.per_group(classes, "block", list_reps, X.ANSWER)
    found = X.checkpointed(candidates(blocks, reps, nb, shingle, percent, orders))
    labels = components(star_edges(found), "order")
    # a document's class: its roots under every order; without all of them it has no partner
    named = labels.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.xxhash64(*[F.max(F.when(F.col("order") == o, F.col("root"))) for o in range(orders)]).alias("class")).filter(F.col("k") == orders).drop("k")
    members = found.filter("kind = 'doc'").select("id", "n", "x").join(named, "id").select("class", "id", "n", "x")
    root = components(links_of_classes(members, percent))
    by_class = classes.join(root, classes["rep"] == root["id"], "left").select("one", "two", "n", F.coalesce("root", "rep").alias("component_id"))
    linked_rows = full.join(by_class, ["one", "two", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sets.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(rest)


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs``, all columns, of each component: that of smallest doc_id, null ones last; of several such rows any one.

    Rows are judged each: repeated ones are one component, two texts of one doc_id need not be,
    and rows with a null doc_id link by their text. Texts without words link with nothing.
    """
    rows, distinct = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if rows == distinct:
        first = jaccard_components(docs, shingle, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
        return docs.join(first, docs["doc_id"] == first["first_id"], "left_semi")
    # ids do not tell the rows apart: they get numbers, and the smallest id is looked up afterwards
    number = next(name for i in range(len(docs.columns) + 1) if (name := f"row_{i}") not in [c.lower() for c in docs.columns])
    numbered = X.checkpointed(docs.withColumn(number, F.monotonically_increasing_id()))
    found = jaccard_components(numbered.select(F.col(number).alias("doc_id"), "text"), shingle, percent).select(F.col("doc_id").alias("uid"), "component_id")
    named = numbered.select(F.col(number).alias("number"), F.col("doc_id").cast("long").alias("id"))
    first = found.join(named, found["uid"] == named["number"]).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("least")).select(F.col("least.uid").alias("first_id"))
    return numbered.join(first, numbered[number] == first["first_id"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
