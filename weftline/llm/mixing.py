"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target by weight, capped at a multiple of its own size. Within a source a document's expected copies
grow with its length: fragments say little, so a document of fewer than FULL words weighs less (see interest()), and as
many copies go to each unit of weight as bring the source's words to its target, none above the cap. The whole part of
the expected copies is certain. Of the rest a sample is drawn with unequal probabilities: documents are ranked by random
odds divided by their own inclusion odds and taken in that order until the source's remaining words are spent. The sample's size is fixed in words, since that is what the
target counts; one closing document, the one nearest to what is then still missing, brings the source to its target. Where
it would miss by as much as the smallest document left and by over NEAR of the target, documents larger than the rest are set aside and those that still
fit are taken on down the ranks, until a closing document comes near enough or nothing fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch, broadcast_if_small

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SOURCES_BROADCAST = 100_000
FULL = 128  # words from which a document weighs 1; below, it weighs (1 + floor(log2(words))) / 8
CLASSES = 8
NEAR = 0.005  # of its target: a source that a closing document brings so near needs no more rounds


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def interest(size: Column) -> Column:
    """Class of a document by its words, 0 to CLASSES - 1; class k weighs (k + 1) / CLASSES."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)))), F.lit(CLASSES - 1)).cast("int")


def expected_copies(words: list[Column], target: Column, cap: float) -> Column:
    """Array of the expected copies of a document of each class, for a source that has these words in each class.

    Copies are level x weight, at most cap. The level is the first, from none capped on, at which the heaviest class that
    is not capped stays within the cap.
    """
    levels = []
    for k in range(CLASSES - 1, -1, -1):  # classes above k are capped
        spent = sum(words[k + 1 :], F.lit(0)) * cap
        rest = sum((w * ((j + 1) / CLASSES) for j, w in enumerate(words[: k + 1])), F.lit(0.0))
        level = F.when(rest > 0, F.greatest(target - spent, F.lit(0.0)) / rest)
        levels.append(F.when(level * ((k + 1) / CLASSES) <= cap * (1 + 1e-12), level))
    level = F.coalesce(*levels, F.lit(cap * CLASSES))
    return F.array(*[F.least(F.lit(cap), F.round(level * ((k + 1) / CLASSES), 12)) for k in range(CLASSES)])


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row per source throughout.

    Sources in code-point order, null last, take the weights in turn. Shares are filled like water: with the sources
    sorted by cap over weight, the level is that of the first source whose share at this level stays within its cap.
    """
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("_w", w.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(cap))
    s = s.withColumn("_level", F.col("_cap") / F.col("_w"))
    rising = everything.orderBy("_level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    falling = everything.orderBy("_level", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("_cap").over(rising), F.lit(0.0))
    s = s.withColumn("_lam", (F.sum("source_size").over(everything) * F.lit(share) - spent) / F.sum("_w").over(falling))
    s = s.withColumn("_lam", F.max(F.when(F.col("_lam") <= F.col("_level"), F.col("_lam"))).over(everything))
    s = s.withColumn("target", F.least("_cap", F.coalesce(F.col("_lam") * F.col("_w"), F.col("_cap"))))
    return s.select("source", "source_size", "target")


def mix_sources(docs: DataFrame, seed: int = 29, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs plus size, source_size (long), target (double), copies (int) and taken (long = copies x size).

    docs needs doc_id, text and source; other columns pass through, of those five names the new ones replace the old.
    A null text has size 0 and takes nothing; a null source is a source; rows equal in doc_id and text share their random
    number and are taken together; a null doc_id is like any value. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    number = F.xxhash64(F.lit(seed), "doc_id", "text")
    light = scratch.put(docs.select("source", word_count(F.col("text")).alias("size"), number.alias("_h")))
    n = light.count()

    in_class = [F.sum(F.when(interest(F.col("size")) == k, F.col("size")).otherwise(0)).alias(f"_w{k}") for k in range(CLASSES)]
    sizes = scratch.put(light.groupBy("source").agg(F.sum("size").alias("source_size"), *in_class))
    plan = source_targets(sizes.select("source", "source_size"), share, cap, weights)
    words = [F.col(f"_w{k}") for k in range(CLASSES)]
    plan = plan.join(sizes.drop("source_size").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    plan = plan.withColumn("_copies", expected_copies(words, F.col("target"), cap))
    plan = plan.withColumn("_rest", F.col("target") - sum((w * F.floor(F.get("_copies", F.lit(k))) for k, w in enumerate(words)), F.lit(0)))
    plan = scratch.put(plan.select("source", "source_size", "target", "_copies", "_rest"))

    uniform = (F.shiftrightunsigned("_h", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    odds = (F.lit(1.0) * uniform / (1 - uniform)) / (F.col("_p") / (1 - F.col("_p")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    def ranked(df: DataFrame, table: DataFrame) -> DataFrame:
        table = broadcast_if_small(table, SOURCES_BROADCAST)
        out = df.join(table, same(df, table), "left").drop(table["source"])
        mean = F.get("_copies", interest(F.col("size")))
        out = out.withColumns({"_whole": F.floor(mean).cast("int"), "_p": mean - F.floor(mean)})
        return out.withColumn("_q", F.when(F.col("_p") > 0, odds))

    bins = int(max(256, min(1 << 20, n // 20_000)))
    slot = F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * bins), F.lit(bins - 1))
    rank = F.struct("_q", "_h")
    at = lambda q: F.struct(F.lit(q).alias("_q"), F.lit(0).cast("long").alias("_h"))
    # Each round takes the ranks between two documents that do not fit, of documents up to a size.
    taken = F.exists("_took", lambda t: (rank > t["lo"]) & (rank < t["hi"]) & (F.col("size") <= t["most"]))
    place = "struct<_q: double, _h: bigint>"
    plan = plan.withColumns({"_took": F.array().cast(f"array<struct<lo: {place}, hi: {place}, most: bigint>>"), "_lo": at(-1.0), "_most": F.lit((1 << 63) - 1), "_gap": F.col("_rest"), "_open": F.lit(True), "_close": F.lit(None).cast("long")})
    state = plan.columns
    plan = scratch.put(plan)
    while True:
        # A histogram of the ranks finds, for each source, the thin slice in which its words run out.
        drawn = ranked(light, plan).where((F.col("_open") & F.col("_q").isNotNull()) & (F.col("size") > 0) & (F.col("size") <= F.col("_most")) & (rank > F.col("_lo"))).withColumn("_bin", slot)
        by_bin = drawn.groupBy("source", "_bin").agg(F.sum("size").alias("_words"), F.first("_gap").alias("_gap"))
        by_bin = by_bin.withColumn("_upto", F.sum("_words").over(Window.partitionBy("source").orderBy("_bin")))
        edge = by_bin.groupBy("source").agg(F.max("_upto").alias("_all"), F.min(F.when(F.col("_upto") > F.col("_gap"), F.struct("_bin", (F.col("_upto") - F.col("_words")).alias("_before")))).alias("_e"))
        edge = scratch.put(edge.select("source", "_all", F.col("_e._bin").alias("_edge"), F.col("_e._before").alias("_before")))
        plan = scratch.put(plan.join(edge, same(plan, edge), "left").drop(edge["source"]))

        inner = ranked(light, plan).where((F.col("_open") & F.col("_q").isNotNull()) & (F.col("size") > 0) & (F.col("size") <= F.col("_most")) & (rank > F.col("_lo"))).withColumn("_bin", slot).where("_bin = _edge")
        inner = inner.withColumn("_upto", F.col("_before") + F.sum("size").over(Window.partitionBy("source").orderBy("_q", "_h").rangeBetween(Window.unboundedPreceding, 0)))
        cut = scratch.put(inner.groupBy("source").agg(F.min(F.when(F.col("_upto") > F.col("_gap"), rank)).alias("_stop"), F.max(F.when(F.col("_upto") <= F.col("_gap"), F.col("_upto"))).alias("_got")))
        plan = plan.join(cut, same(plan, cut), "left").drop(cut["source"])
        # None of the slice fits: the words are those before it. No slice: all fit.
        got = F.when(F.col("_edge").isNull(), F.coalesce("_all", F.lit(0))).otherwise(F.coalesce("_got", "_before"))
        plan = plan.withColumn("_hi", F.coalesce("_stop", at(float("inf")))).withColumn("_gap", F.when(F.col("_open"), F.col("_gap") - got).otherwise(F.col("_gap")))
        span = F.array(F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_most").alias("most")))
        plan = plan.withColumn("_took", F.when(F.col("_open"), F.concat("_took", span)).otherwise(F.col("_took")))
        plan = scratch.put(plan.withColumn("_lo", F.col("_hi")).withColumn("_most", F.floor("_gap")).select(state))

        miss = F.abs(F.col("size") - F.col("_gap"))
        left = ranked(light, plan).where(F.col("_open") & F.col("_q").isNotNull() & (F.col("size") > 0) & ~taken)
        left = scratch.put(left.groupBy("source").agg(F.min(F.when(miss < F.col("_gap"), F.struct(miss.alias("_miss"), "_q", "_h"))).alias("_best"), F.min("size").alias("_least"), F.max((F.col("size") <= F.col("_most")) & (rank > F.col("_lo"))).alias("_fits")))
        plan = plan.join(left, same(plan, left), "left").drop(left["source"])
        goes_on = F.col("_open") & F.coalesce(F.col("_fits") & (F.col("_best._miss") >= F.col("_least")) & (F.col("_best._miss") > NEAR * F.col("target")), F.lit(False))
        plan = plan.withColumn("_close", F.when(F.col("_open") & ~goes_on, F.col("_best._h")).otherwise(F.col("_close"))).withColumn("_open", goes_on)
        plan = scratch.put(plan.select(state))
        if not plan.where("_open").limit(1).count():
            break

    out = docs.withColumn("size", word_count(F.col("text"))).withColumn("_h", number)
    out = ranked(out, plan)
    copies = F.col("_whole") + F.when(F.coalesce(F.col("_q").isNotNull() & taken, F.lit(False)) | F.coalesce(F.col("_h") == F.col("_close"), F.lit(False)), 1).otherwise(0)
    out = out.withColumn("copies", F.least(copies, F.lit(int(cap))).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")


def op3(spark, sf_dir: str) -> DataFrame:
    """The registered query: the words the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
