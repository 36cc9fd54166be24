"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a target size by weight (capped at twice its own size, the excess reshared
by weight), so each of its documents gets target / size copies: a whole number and a
fractional part, the probability of one copy more. Pivotal rounding makes the parts integral:
two documents meet, and words (size x probability) move at random from one to the other,
until one probability is 0 or 1; the mean of each is kept and so is the sum of words, so a
source misses its target by less than one document. Leaves of about ``LEAF`` documents are
folded in parallel; each leaves at most one undecided document, and those meet again in the
next level of a reduction tree, until one per source is left, which is drawn alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.exchange import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
LEAF = 128
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def uniform(*cols: Column | str) -> Column:
    """A reproducible number in [0, 1) drawn from the values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target) from (source, size): one row per source.

    Sources in code-point order, null last, take the weights in turn. A source is capped
    where its fair share at the final level would exceed cap x size: with sources by falling
    weight / room, all up to some place are capped and the rest share what is left.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # one row per source: a ranking over them is as long as the list of sources, never as the documents
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    room = F.col("source_size") * F.lit(cap)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    fill = Window.orderBy((room / F.col("weight")), F.col("source").isNull(), F.col("source"))
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("room", room).withColumn("left", total - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(after))
    # the level at the first source that it does not fill holds for all from there on
    s = s.withColumn("open", F.col("weight") * F.col("level") <= F.col("room"))
    s = s.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.row_number().over(fill).alias("r"), "level"))).over(Window.partitionBy())["level"])
    target = F.when(F.col("final").isNull(), F.col("room")).otherwise(F.least(F.col("room"), F.col("weight") * F.col("final")))
    return s.select("source", "source_size", "n", target.alias("target"))


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """Fold step: the undecided document of ``acc`` meets ``x``; one of them becomes decided."""
    h = acc["held"]
    # words that can move from h to x before one of the two is integral, and from x to h
    out = F.least(h["p"] * h["size"], (F.lit(1.0) - x["p"]) * x["size"])
    back = F.least((F.lit(1.0) - h["p"]) * h["size"], x["p"] * x["size"])
    draw = uniform(h["place"], x["place"], F.lit(seed))
    move = F.when(draw * (out + back) < back, -out).otherwise(back)  # words that h gains
    hp, xp = h["p"] + move / h["size"], x["p"] - move / x["size"]
    eps = 1e-12

    def settled(p: Column) -> Column:
        return (p <= eps) | (p >= 1.0 - eps)

    def doc(d: Column, p: Column) -> Column:
        return F.struct(d["place"].alias("place"), d["uid"].alias("uid"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["whole"].alias("whole"), p.alias("p"))

    a, b = doc(h, F.when(hp <= eps, 0.0).when(hp >= 1.0 - eps, 1.0).otherwise(hp)), doc(x, F.when(xp <= eps, 0.0).when(xp >= 1.0 - eps, 1.0).otherwise(xp))
    return (F.when(h.isNull(), F.struct(x.alias("held"), acc["done"].alias("done")))
            .when(settled(hp), F.struct(b.alias("held"), F.concat(acc["done"], F.array(a)).alias("done")))
            .otherwise(F.struct(a.alias("held"), F.concat(acc["done"], F.array(b)).alias("done"))))


def _with_target(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row beside its source's target; a hot source is the streamed side, which adaptive execution splits."""
    t = targets.withColumnRenamed("source", "target_source")
    return rows.join(t, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")


def _numbered(d: DataFrame) -> DataFrame:
    """The rows of ``d`` with ``place``, a hash that tells equal rows apart, so that they are
    dealt to different leaves. Equal rows are numbered from 0 without being gathered: counted
    per partition, the counts summed up along the partitions, then written out again."""
    same = ["doc_id", "source", "size", "uid"]
    part = d.groupBy(*same, F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = part.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0)))
    nth = F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("nth")
    return start.select(*same, nth).withColumn("place", F.when(F.col("nth") == 0, F.col("uid")).otherwise(F.xxhash64("uid", "nth"))).drop("nth")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 4, keep_uid: bool = False) -> DataFrame:
    """How many copies of each document the mix takes, near each source's target.

    Returns (doc_id, source, size, source_size, target, copies, taken): one row per input
    row; size is the number of words (null text: 0), taken = copies x size and never above
    cap x size rounded up to whole copies. A null source is a source of its own, last in
    order. Documents without words are taken 0 times. Draws depend on doc_id, text and seed
    alone, so reruns agree; equal repeated rows are numbered and drawn each for itself. A null doc_id is an id
    like any other. Extra columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("uid"))
    d = checkpointed(d)  # the texts are read once; what follows works on four numbers a row
    targets = checkpointed(source_targets(d, weights, share, cap))
    most = targets.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    left = _with_target(_numbered(d), targets).withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    # a rate within rounding of a whole number is one
    left = left.withColumn("whole", F.when(F.col("p") > 1 - 1e-12, F.col("whole") + 1).otherwise(F.col("whole"))).withColumn("p", F.when((F.col("p") > 1 - 1e-12) | (F.col("p") < 1e-12) | (F.col("size") == 0), 0.0).otherwise(F.col("p")))
    sure = left.filter("p = 0").select("uid", "doc_id", "source", "size", F.col("whole").alias("copies"))
    open_ = left.filter("p > 0").select("source", "n", F.struct("place", "uid", "doc_id", F.col("size").cast("double").alias("size"), "whole", "p").alias("d"))
    decided, level = [sure], 0
    none = F.expr("cast(null as struct<place:bigint,uid:bigint,doc_id:bigint,size:double,whole:bigint,p:double>)")
    while True:
        last = most <= LEAF
        leaves = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(LEAF)))
        key = F.lit(0) if last else F.pmod(F.xxhash64(F.col("d.place"), F.lit(seed + 1000 + level)), leaves)
        folded = (open_.groupBy("source", "n", key.alias("leaf")).agg(F.sort_array(F.collect_list("d")).alias("ds"))
                  .select("source", F.ceil(F.col("n") / F.lit(LEAF)).alias("n"),
                          F.aggregate("ds", F.struct(none.alias("held"), F.expr("cast(array() as array<struct<place:bigint,uid:bigint,doc_id:bigint,size:double,whole:bigint,p:double>>)").alias("done")),
                                      lambda acc, x: _meet(acc, x, seed + level)).alias("r")))
        folded = checkpointed(folded)
        held = folded.select("source", "n", F.col("r.held").alias("d")).filter("d is not null")
        done = folded.select("source", F.explode("r.done").alias("d"))
        if last:
            alone = held.select("source", F.col("d").withField("p", F.when(uniform(F.col("d.place"), F.lit(seed + 999)) < F.col("d.p"), 1.0).otherwise(0.0)).alias("d"))
            done = done.unionByName(alone)
        decided.append(done.select(F.col("d.uid").alias("uid"), F.col("d.doc_id").alias("doc_id"), "source", F.col("d.size").cast("long").alias("size"), (F.col("d.whole") + F.round("d.p").cast("long")).alias("copies")))
        if last:
            break
        open_, most, level = held, -(-most // LEAF), level + 1
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return _with_target(out, targets).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *["uid"] * keep_uid)


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it (see mix_sources).

    Rows meet their number of copies by a hash of doc_id and text; equal repeated rows are
    numbered, so each meets its own.
    """
    mixed = mix_sources(docs, weights, share, cap, seed, keep_uid=True).select("uid", "copies")
    mixed = mixed.withColumn("nth", F.row_number().over(Window.partitionBy("uid").orderBy("copies"))).filter("copies > 0")
    # whole rows travel as one struct, so their column names cannot clash
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("uid"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("uid").orderBy("row.doc_id")))
    taken = rows.join(mixed, ["uid", "nth"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("row.*")
