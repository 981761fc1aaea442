"""Merkle dataset manifest: bitmaps of doc_ids give every leaf its place by rank, keyed slot arrays reduce a level at a time.

A group (a source) is a tree of its leaves in doc_id order with runs of FAN nodes; the groups' roots form one more tree.
Partial bitmaps of each group are merged by OR into blocks of BLOCK ids that hold a popcount directory; ranks come from
them, so that no leaves are sorted. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch

FAN = 16  # nodes that become one
BLOCK, WORDS = 1024, 16  # ids in a block, words of 64 bits that hold them
DIRECTORY = 1024  # entries that are summed up in one group of the directory
NO_ID = -(1 << 54) - 1  # the block of null ids, before all others
PATH = "array<struct<nodes:binary,p:int>>"  # runs from a leaf's up to the root's, and the place in each
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(node: Column) -> Column:
    return F.lower(F.hex(node))


def leaf_digest(*values: Column) -> Column:
    """Digest of the values, each as its UTF-8 length, a colon and itself; null is a dash."""
    text = [v.cast("string") for v in values]
    return digest(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]))


# ---- places -----------------------------------------------------------------------------------------------------------


def _before(scratch: Scratch, counts: DataFrame) -> DataFrame:
    """counts(_s, _b, n) to (_s, _b, _ahead): rows of the group in the blocks before; entries are summed by DIRECTORY at a time."""
    most = counts.groupBy("_s").count().agg(F.max("count")).first()[0] or 0
    upto = lambda *key: F.sum("n").over(Window.partitionBy(*key).orderBy("_b")) - F.col("n")
    if most <= DIRECTORY:
        return counts.select("_s", "_b", upto("_s").alias("_ahead"))
    lower = counts.withColumn("_up", F.expr(f"shiftright(_b, {DIRECTORY.bit_length() - 1})"))
    upper = _before(scratch, scratch.put(lower.groupBy("_s", "_up").agg(F.sum("n").alias("n")).withColumnRenamed("_up", "_b")))
    upper = upper.select("_s", F.col("_b").alias("_up"), F.col("_ahead").alias("_base"))
    return lower.withColumn("_in", upto("_s", "_up")).join(upper, ["_s", "_up"]).select("_s", "_b", (F.col("_in") + F.col("_base")).alias("_ahead"))


def bitmap_index(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows(_s, _b, _k) to blocks (_s, _b, bits, dir, n, _ahead): WORDS words of a bitmap, and how many bits stand before each.

    Tasks make bitmaps of what they read and the shuffle merges them by OR; empty blocks are not kept.
    """
    words = [F.bit_or(F.expr(f"if(shiftright(_k, 6) = {i}, shiftleft(1L, _k & 63), 0L)")).alias(f"w{i}") for i in range(WORDS)]
    merged = rows.groupBy("_s", "_b").agg(*words, F.count(F.lit(1)).alias("n"))
    bits = [F.col(f"w{i}") for i in range(WORDS)]
    sums, ahead = F.lit(0), []
    for b in bits:
        ahead.append(sums)
        sums = sums + F.bit_count(b)
    blocks = scratch.put(merged.select("_s", "_b", F.array(*bits).alias("bits"), F.array(*ahead, sums).alias("dir"), "n"))
    return scratch.put(blocks.join(_before(scratch, blocks.select("_s", "_b", "n")), ["_s", "_b"]))


def _ties(rows: DataFrame) -> DataFrame:
    """rows that share (_s, _b, _k) with others, plus _tie: their order by leaf, then by where they were read.

    Leaves are digests, so their first two bytes cut any number of them into even slices; equal leaves are counted by the
    file part they were read from. No group holds more than a slice or a part.
    """
    key = ["_s", "_b", "_k"]
    rows = rows.withColumns({"_cut": F.substring("leaf", 1, 2), "_part": F.expr("shiftright(_row, 33)")})
    each = rows.groupBy(*key, "_cut", "leaf", "_part").agg(F.count(F.lit(1)).alias("c"))
    cuts = each.groupBy(*key, "_cut").agg(F.sum("c").alias("n"))
    cuts = cuts.select(*key, "_cut", (F.sum("n").over(Window.partitionBy(*key).orderBy("_cut")) - F.col("n")).alias("_base"))
    inner = F.sum("c").over(Window.partitionBy(*key, "_cut").orderBy("leaf", "_part")) - F.col("c")
    each = each.withColumn("_in", inner).join(cuts, [*key, "_cut"]).select(*key, "leaf", "_part", (F.col("_in") + F.col("_base")).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(*key, "leaf", "_part").orderBy("_row")) - 1
    return rows.withColumn("_nth", nth).join(each, [*key, "leaf", "_part"]).withColumn("_tie", F.col("_start") + F.col("_nth")).drop("_cut", "_part", "_nth", "_start")


def place_leaves(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """leaves(doc_id, source, leaf, …) plus _s (the source as a key that is never null), slot and n, the group's size.

    A slot is the rank of its doc_id in the group's bitmap; null ids come first, rows of one id stand in the order of their
    leaves. Ids that many rows share are ranked apart, in even slices.
    """
    clear = leaves.drop("_s", "_b", "_k", "_row", "_tie", "slot", "n")
    rows = scratch.put(clear.withColumns({
        "_s": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "_b": F.coalesce(F.expr("shiftright(doc_id, 10)"), F.lit(NO_ID)),
        "_k": F.coalesce((F.col("doc_id").bitwiseAND(BLOCK - 1)).cast("int"), F.lit(0)), "_row": F.monotonically_increasing_id(),
    }))
    blocks = bitmap_index(scratch, rows)
    sizes = scratch.put(blocks.groupBy("_s").agg(F.sum("n").alias("_size")))
    blocks = blocks.join(sizes, "_s")
    repeated = F.col("n") > F.element_at("dir", WORDS + 1)
    if blocks.where(repeated).limit(1).count():
        several = rows.join(blocks.where(repeated).select("_s", "_b"), ["_s", "_b"], "left_semi").groupBy("_s", "_b", "_k").agg((F.count(F.lit(1)) - 1).alias("_more")).where("_more > 0")
        several = scratch.put(several)
        blocks = blocks.join(several.groupBy("_s", "_b").agg(F.collect_list(F.struct("_k", "_more")).alias("_repeats")), ["_s", "_b"], "left")
        known = rows.join(several, ["_s", "_b", "_k"], "left")
        alone = known.where("_more is null").withColumn("_tie", F.lit(0).cast("long"))
        rows = alone.unionByName(_ties(known.where("_more is not null"))).drop("_more")
    else:
        blocks = blocks.withColumn("_repeats", F.lit(None).cast("array<struct<_k:int,_more:bigint>>"))
        rows = rows.withColumn("_tie", F.lit(0).cast("long"))
    found = rows.join(blocks.drop("n"), ["_s", "_b"])
    word = F.expr("shiftright(_k, 6) + 1")
    inside = F.element_at("dir", word) + F.bit_count(F.element_at("bits", word).bitwiseAND(F.expr("~shiftleft(-1L, _k & 63)")))
    more = F.aggregate(F.filter("_repeats", lambda r: r["_k"] < F.col("_k")), F.lit(0).cast("long"), lambda acc, r: acc + r["_more"])
    slot = F.col("_ahead") + inside + F.coalesce(more, F.lit(0)) + F.col("_tie")
    return scratch.put(found.select(*clear.columns, "_s", slot.cast("long").alias("slot"), F.col("_size").alias("n")))


def in_order(scratch: Scratch, rows: DataFrame, key: str) -> DataFrame:
    """rows of distinct keys plus slot, their place by key: ranges are sorted each in its task, then their sizes added up."""
    dealt = scratch.put(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.expr("shiftright(_at, 33)").alias("_part")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # one row a task
    sizes = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_base"))
    return dealt.withColumn("_part", part).join(sizes, "_part").withColumn("slot", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_at")


# ---- trees ------------------------------------------------------------------------------------------------------------


def reduce_levels(scratch: Scratch, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes(_s, slot, n, node) to the runs of each level (_s, run, n, nodes, parent), and the top (_s, node) of each tree.

    A run is keyed by the slots' quotient, and holds its nodes by their remainder. A tree of one node is its own top.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    runs, tops = [], nodes.where("n = 1").select("_s", "node")
    while most > 1:
        held = F.array_sort(F.collect_list(F.struct((F.col("slot") % FAN).alias("p"), F.hex("node").alias("h"))))
        run = nodes.where("n > 1").groupBy("_s", F.expr(f"slot div {FAN}").alias("run")).agg(F.first("n").alias("n"), held.alias("_held"))
        run = run.withColumn("nodes", F.unhex(F.array_join("_held.h", ""))).drop("_held")
        runs.append(scratch.put(run.withColumn("parent", digest(hexed(F.col("nodes"))))))
        nodes = runs[-1].select("_s", F.col("run").alias("slot"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("parent").alias("node"))
        tops = tops.union(nodes.where("n = 1").select("_s", "node"))
        most = -(-most // FAN)
    return runs, tops


def paths_down(scratch: Scratch, runs: list[DataFrame], above: DataFrame) -> DataFrame:
    """(_s, run, nodes, sub, path) for the runs of the lowest level: the path of the runs that follow up to the root.

    above(_s, sub, path) has what follows the top of each tree. A run's path is made once for all its nodes.
    """
    step, out = None, None
    for k in reversed(range(len(runs))):
        out = runs[k].where(f"n <= {FAN}").join(above, "_s")
        if step is not None:
            out = out.unionByName(runs[k].where(f"n > {FAN}").join(step, ["_s", "run"]))
        out = out.select("_s", "run", "nodes", "sub", "path")
        if k:
            place = F.explode(F.sequence(F.lit(0), F.expr("octet_length(nodes) div 32 - 1").cast("int")))
            step = out.select("_s", "run", "nodes", "sub", "path", place.alias("p"))
            step = scratch.put(step.select("_s", F.expr(f"run * {FAN} + p").alias("run"), "sub", F.concat(F.array(F.struct("nodes", "p")).cast(PATH), "path").alias("path")))
    return out


def siblings(x: Column) -> tuple[Column, Column]:
    """The digests left and right of a place in a run, as text."""
    text = hexed(x["nodes"])
    return F.substring(text, F.lit(1), x["p"] * 64), F.substring(text, x["p"] * 64 + 65, F.lit(64 * FAN))


def proof(path: Column) -> Column:
    """Text of all siblings, level by level."""
    return F.array_join(F.transform(path, lambda x: F.concat(*siblings(x))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(siblings(x)[0], node, siblings(x)[1]), 256))


@dataclass(frozen=True)
class Manifest:
    """leaves (the rows given, _s, slot, n, sub, path), subroots (source, subroot, n_leaves), levels (runs by level), root (hex, None if empty)."""

    leaves: DataFrame
    subroots: DataFrame
    levels: list[DataFrame]
    root: str | None

    def write(self, path: str) -> None:
        """Leaves, subroots and every level as Parquet below path; the paths are left out, since the levels give them."""
        self.leaves.drop("path", "sub", "_s").write.mode("overwrite").parquet(f"{path}/leaves")
        self.subroots.withColumn("root", F.lit(self.root)).write.mode("overwrite").parquet(f"{path}/subroots")
        for k, level in enumerate(self.levels):
            level.select(F.expr("nullif(substring(_s, 2), '')").alias("source"), "run", "nodes", "parent").write.mode("overwrite").parquet(f"{path}/level={k}")


def build_manifest(leaves: DataFrame) -> Manifest:
    """The manifest of leaves(doc_id, source, leaf (32 bytes), any other columns, which are kept unless they clash).

    Null sources and ids come first; rows of one id keep their own leaves, in the order of these; equal rows too. An empty
    table has no root. Nothing about single rows reaches the driver.
    """
    spark = leaves.sparkSession
    scratch = Scratch(spark, "manifest")
    placed = place_leaves(scratch, leaves.drop("sub", "path", "run"))
    runs, tops = reduce_levels(scratch, placed.select("_s", "slot", "n", F.col("leaf").alias("node")))
    groups = scratch.put(in_order(scratch, tops, "_s"))
    n = groups.count()
    upper, top = reduce_levels(scratch, groups.select(F.lit("").alias("_s"), "slot", F.lit(n).cast("long").alias("n"), "node"))
    root = top.select(hexed(F.col("node"))).first() if n else None
    none = F.array().cast(PATH)
    if upper:
        start = spark.range(1).select(F.lit("").alias("_s"), F.lit(None).cast("binary").alias("sub"), none.alias("path"))
        over = paths_down(scratch, upper, start).select("run", "nodes", "path")
        above = groups.withColumn("run", F.expr(f"slot div {FAN}")).join(over, "run")
        above = above.select("_s", F.col("node").alias("sub"), F.concat(F.array(F.struct("nodes", (F.col("slot") % FAN).cast("int").alias("p"))).cast(PATH), "path").alias("path"))
    else:
        above = groups.select("_s", F.col("node").alias("sub"), none.alias("path"))
    above = scratch.put(above)
    lone = placed.where("n = 1").join(above, "_s")
    if runs:
        down = paths_down(scratch, runs, above)
        many = placed.where("n > 1").withColumn("run", F.expr(f"slot div {FAN}")).join(down, ["_s", "run"]).drop("run")
        own = F.array(F.struct("nodes", (F.col("slot") % FAN).cast("int").alias("p"))).cast(PATH)
        lone = lone.unionByName(many.withColumn("path", F.concat(own, "path")).drop("nodes"))
    sizes = placed.groupBy("_s").agg(F.first("n").alias("n_leaves"))
    source = F.when(F.col("_s") != "", F.expr("substring(_s, 2)"))
    subroots = groups.join(sizes, "_s").select(source.alias("source"), hexed(F.col("node")).alias("subroot"), "n_leaves")
    return Manifest(lone, subroots, [*runs, *upper], root and root[0])


def op11(spark, sf_dir: str) -> DataFrame:
    """Every row of documents proves its leaf, or one from a text whose capitals were lowered, against the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = {c: F.col(c) for c in FIELDS}
    low = fields | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_digest(*fields.values()).alias("leaf"), F.when(touched, leaf_digest(*low.values())).alias("other"))
    m = build_manifest(leaves)
    out = m.leaves.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("sub")).alias("subroot"), F.lit(m.root).cast("string").alias("root"),
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(hexed(F.coalesce("other", "leaf")), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
