"""Merkle manifest of a dataset: a tree of hashes per group, a tree over the groups' roots, and
per-leaf proofs by a recursive query.

Leaves are numbered within their group by a range partitioning and per-partition offsets.
Levels are built block by block (2^BLOCK neighbouring leaves), then over the blocks' roots,
and stored as parent-linked node rows: a row stands for a node at every SPAN-th level and
holds the siblings that its ancestors below the linked parent row meet. The recursive query
starts with all leaves, emits their siblings and folds the presented hash with them, joins
the linked node row, and so on until there is none. So that no
key becomes hot near the root, node rows above the blocks are stored once per block below
them: a key is shared by at most 2^BLOCK leaves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.exchange import released
from trafficlens.llm.token_output import shared_folder

#: levels between a node row and its parent row; levels of a block (a multiple of SPAN)
SPAN, BLOCK = 4, 12
#: levels of the tree over the groups are numbered from here
UPPER = 1000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

SIBLINGS = "array<struct<l: binary, r: binary>>"
NODES = f"grp long, level int, idx long, hash binary, siblings {SIBLINGS}, doc_id long, presented binary"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_hash(columns: dict[str, Column]) -> Column:
    """sha256 over the columns: ``-`` for null, else byte count, ``:`` and value."""
    parts = []
    for c in columns.values():
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(c: str) -> Column:
    return F.lower(F.hex(c))


def numbered(df: DataFrame, name: str, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """(df with ``pos``, its place from 0 within ``group`` by ``order``; (group, n) of the groups).

    Rows are range-partitioned and sorted, and carry their place in the partition; what comes
    before in other partitions is a running count per (group, partition). Equal rows are told
    apart by a number they are stored with, so a value that very many rows share is split too.
    """
    df = stored(df.withColumn("_row", F.monotonically_increasing_id()), f"{name}-rows")
    by = [F.asc_nulls_first(c) for c in (group, *order, "_row")]
    at = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)).drop("_row"), f"{name}-sorted")
    counts = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(whole))
    counts = stored(counts, f"{name}-counts")
    out = rows.join(counts.select(group, "_part", "_first", "_before", "n"), [group, "_part"])
    return (out.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"),
            counts.select(group, "n").distinct())


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


def _build(base: int):
    """Levels of one block from level ``base`` on: node rows at every SPAN-th level, and the block's top."""

    def block(t: pa.Table) -> pa.Table:
        grp, n = t["grp"][0].as_py(), t["n"][0].as_py()
        rows = sorted(zip(*(t[c].to_pylist() for c in ("pos", "hash", "doc_id", "presented")), strict=True), key=lambda r: r[0])
        low, top = rows[0][0], min(base + BLOCK, height(n))
        levels = [[r[1] for r in rows]]
        while base + len(levels) - 1 < top:
            below = [h.hex() for h in levels[-1]]
            levels.append([hashlib.sha256("".join(below[i : i + 2]).encode()).digest() for i in range(0, len(below), 2)])
        out: dict[str, list] = {"grp": [], "level": [], "idx": [], "hash": [], "siblings": [], "doc_id": [], "presented": []}

        def add(*row) -> None:
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)

        for start in range(0, max(top - base, base == 0), SPAN):  # leaves have a row also where they are roots
            for i, h in enumerate(levels[start]):
                path = []
                for up, level in enumerate(levels[start : max(0, min(start + SPAN, top - base))]):
                    j = (i >> up) ^ 1
                    other = level[j] if j < len(level) else None
                    path.append({"l": other if j & 1 == 0 else None, "r": other if j & 1 else None})
                add(grp, base + start, (low >> start) + i, h, path, *(rows[i][2:] if base + start == 0 else (None, None)))
        add(grp, -1, low >> BLOCK, levels[-1][0], None, None, None)  # the block's top, no node row
        kind = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), kind, pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out.values(), types, strict=True)], list(out))

    return block


def build(leaves: DataFrame, sizes: DataFrame, largest: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(node rows NODES, (grp, hash) roots) of leaves (grp, pos, n, hash, doc_id, presented).

    ``sizes`` has (grp, n) of all groups, ``largest`` is the largest n: it gives the number of rounds, one for each BLOCK levels."""
    nodes, base, at = None, 0, leaves
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("presented")]
    while True:
        built = stored(at.withColumn("_block", F.shiftright("pos", BLOCK)).groupBy("grp", "_block").applyInArrow(released(_build(base)), NODES), f"{name}-{base}")
        here = built.filter("level >= 0")
        nodes = here if nodes is None else nodes.unionByName(here)
        tops = built.filter("level < 0").select("grp", F.col("idx").alias("pos"), "hash")
        base += BLOCK
        if height(largest) <= base:
            return nodes, tops.select("grp", "hash")
        at = tops.join(sizes, "grp").select("grp", "pos", "n", "hash", *none)


@dataclass
class Manifest:
    """leaves   (grp, idx, hash, siblings, doc_id, presented, up_level, up_slot): every row's node row,
             with the hash to verify where that is another one
    nodes    (grp, level, slot, siblings, up_level, up_slot): the node rows above them
    roots    (grp, lang, subroot, root)
    """

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame


def tampered_chars(doc_id: Column, n_chars: Column) -> Column:
    """n_chars, one more where 7 divides the crc32 of the decimal doc_id."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    return F.when(F.coalesce(hit, F.lit(False)), n_chars + 1).otherwise(n_chars)


def build_manifest(docs: DataFrame, presented: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs`` (FIELDS; other columns are ignored): groups by lang, leaves by doc_id.

    ``presented`` replaces columns in the rows whose hashes are to be verified. Nulls: any field may
    be null (hashed as ``-``); null langs are a group, the first; null doc_ids come first in
    their group. Ties and repeated rows: equal doc_ids are ordered by their hash, and every row
    is a leaf. Empty and very long texts are hashed whole, inside the JVM. A group of one leaf has that
    leaf as its root; an empty table has no rows anywhere.
    """
    columns = {c: F.col(c) for c in FIELDS}
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("key")
    leaf, shown = row_hash(columns), row_hash(columns | (presented or {}))
    hashes = docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("hash"), F.when(shown != leaf, shown).alias("presented"))
    leaves, sizes = numbered(hashes, "merkle-leaves", "key", "doc_id", "hash")
    groups, _ = numbered(sizes.select("key", F.lit(0).alias("all")), "merkle-groups", "all", "key")
    groups = stored(groups.select("key", F.col("pos").alias("grp"), F.col("n").alias("groups")).join(sizes, "key"), "merkle-group-list")
    largest, many = groups.agg(F.max("n"), F.max("groups")).first()
    leaves = leaves.join(groups.select("key", "grp"), "key").select("grp", "pos", "n", "hash", "doc_id", "presented")
    low, subroots = build(leaves, groups.select("grp", "n"), largest or 0, "merkle-nodes")
    all_groups = F.lit(many or 0).cast("long").alias("n")
    tops = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), all_groups, "hash", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("presented"))
    one = groups.select(F.lit(0).cast("long").alias("grp"), all_groups).distinct()
    high, root = build(tops, one, many or 0, "merkle-upper")

    top = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)  # height(n)
    groups = groups.withColumn("top", top)
    nodes = low.join(groups.select("grp", "top", "groups"), "grp")
    first_upper = F.when(F.col("groups") > 1, F.lit(UPPER))
    next_level = F.when(F.col("level") + SPAN < F.col("top"), F.col("level") + SPAN).otherwise(first_upper)
    # the last row of a group of one block leads to the upper tree, by block 0
    inner_top = F.when(F.col("top") > BLOCK, BLOCK + 1).otherwise(F.col("top"))
    up_slot = F.when(F.col("level") + SPAN < inner_top, F.shiftright("idx", SPAN)).otherwise(0)
    below = nodes.filter(F.col("level") < BLOCK).withColumn("up_level", next_level).withColumn("up_slot", up_slot)
    inside = below.filter("level > 0").select("grp", "level", F.col("idx").alias("slot"), "siblings", "up_level", "up_slot")
    parts = [inside]
    blocks = groups.select("grp", "groups", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, BLOCK))).alias("slot"))
    if (largest or 0) > 1 << BLOCK:
        over = blocks.filter(F.col("top") > BLOCK).withColumn("level", F.explode(F.sequence(F.lit(BLOCK), F.col("top") - 1, F.lit(SPAN)))) \
            .withColumn("idx", F.expr(f"shiftright(slot, level - {BLOCK})"))
        over = over.join(nodes.select("grp", "level", "idx", "siblings"), ["grp", "level", "idx"])
        parts.append(over.select("grp", "level", "slot", "siblings", next_level.alias("up_level"), F.col("slot").alias("up_slot")))
    upper_top = height(many or 0)
    upper = blocks.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(0, upper_top - 1)), F.lit(SPAN)))).withColumn("idx", F.expr("shiftright(grp, level)"))
    upper = upper.join(high.select("level", "idx", "siblings"), ["level", "idx"])
    parts.append(upper.select("grp", (F.col("level") + UPPER).alias("level"), "slot", "siblings",
                              F.when(F.col("level") + SPAN < upper_top, F.col("level") + UPPER + SPAN).alias("up_level"), F.col("slot").alias("up_slot")))
    linked = parts[0]
    for p in parts[1:]:
        linked = linked.unionByName(p)
    lang = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30))
    top_hash = root.first()  # of the whole dataset: one row, none for an empty table
    roots = groups.select("grp", lang.alias("lang")).join(subroots.select("grp", hexed("hash").alias("subroot")), "grp") \
        .withColumn("root", F.lit(top_hash["hash"].hex() if top_hash else None).cast("string"))
    own = below.filter("level = 0").select("grp", "idx", "hash", "siblings", "doc_id", "presented", "up_level", "up_slot")
    return Manifest(own, stored(linked, "merkle-links"), roots)


FOLD = "aggregate({siblings}, {hash}, (a, s) -> unhex(sha2(concat(coalesce(lower(hex(s.l)), ''), lower(hex(a)), coalesce(lower(hex(s.r)), '')), 256)))"
MEET = "aggregate({siblings}, X'', (a, s) -> concat(a, coalesce(s.l, s.r, X'')))"

CLIMB = f"""
WITH RECURSIVE climb (grp, pos, step, level, slot, folded, above, doc_id, leaf) AS (
  SELECT grp, idx, 0, up_level, up_slot, {FOLD.format(siblings="siblings", hash="coalesce(presented, hash)")}, {MEET.format(siblings="siblings")}, doc_id, hash FROM {{leaves}}
  UNION ALL
  SELECT c.grp, c.pos, c.step + 1, n.up_level, n.up_slot, {FOLD.format(siblings="n.siblings", hash="c.folded")}, {MEET.format(siblings="n.siblings")},
         CAST(NULL AS BIGINT), CAST(NULL AS BINARY)
  FROM climb c JOIN {{nodes}} n ON n.grp = c.grp AND n.level = c.level AND n.slot = c.slot
)
SELECT * FROM climb
"""


def climb(manifest: Manifest) -> DataFrame:
    """(grp, pos, doc_id, leaf, folded, siblings) of every leaf: its presented hash folded up to the
    root through the stored nodes, and the siblings it met, from the leaf upwards, as one binary.

    A step of the recursion takes all leaves up SPAN levels, so there are as many rows as
    leaves times a sixteenth's logarithm. The session's limit on a recursion's rows, meant
    against endless ones, is lifted: this one ends at the root."""
    spark = manifest.leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    steps = spark.sql(CLIMB, leaves=manifest.leaves, nodes=manifest.nodes)
    last = F.max(F.struct("step", "folded"))["folded"]
    met = F.sort_array(F.collect_list(F.struct("step", "above")))["above"]
    return steps.groupBy("grp", "pos").agg(F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"), last.alias("folded"), met.alias("_met")) \
        .withColumn("siblings", F.aggregate("_met", F.lit(b""), lambda a, x: F.concat(a, x))).drop("_met")


def prove(docs: DataFrame) -> DataFrame:
    """Every row's proof against the manifest of ``docs``: (doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified, lang). The row presented is the stored one, but with n_chars tampered
    where ``tampered_chars`` says so; verified is whether it folds to the root. See
    ``build_manifest`` for nulls, ties, long texts and empty tables."""
    manifest = build_manifest(docs, {"n_chars": tampered_chars(F.col("doc_id"), F.col("n_chars"))})
    folded = climb(manifest).withColumn("folded_root", hexed("folded"))
    return folded.join(manifest.roots, "grp").select("doc_id", hexed("leaf").alias("leaf"), "subroot", "root", F.sha2(hexed("siblings"), 256).alias("proof_sha256"),
                                                     "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "lang")
