"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of the whole record; pass two runs a
Fisher-Yates shuffle over each bucket. Bucket after bucket the shuffled records form one global order, which is cut into
shards whose row counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.shared import Scratch, broadcast_if_small

BUCKET_BYTES = 8 << 20
REPEATS = 1024  # rows of one hash that stay together
BLOCK = 1024  # buckets whose offsets are added up in one group


def _fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """Order after exchanging each place, from the last, with a random one up to it."""
    order, rng = np.arange(n), np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, bucket]))
    for k, r in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)) if n > 1 else ()):
        order[k], order[r] = order[r], order[k]
    return order


def _spread(dealt: DataFrame, often: DataFrame, names: list[str]) -> DataFrame:
    """dealt (names and _key) with a key of its own for each of the equal rows whose key is among often(_key).

    Equal rows are counted, which joins them before the shuffle, and their number is cut into runs of REPEATS that are dealt to
    tasks and made rows again there.
    """
    runs = dealt.join(often, "_key", "left_semi").groupBy("_key", *names).agg(F.count(F.lit(1)).alias("_c"))
    runs = runs.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_c - 1) div {REPEATS}"))))
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(parts, "_key", "_run").withColumn("_i", F.explode(F.sequence(F.col("_run") * REPEATS, F.least((F.col("_run") + 1) * REPEATS, F.col("_c")) - 1)))
    made = runs.select(*names, F.xxhash64("_key", "_i").alias("_key"))
    return dealt.join(often, "_key", "left_anti").select(*names, "_key").union(made)


def shuffle_shards(docs: DataFrame, n_shards: int, seed: int = 17, size_col: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs, plus ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard), in shuffled order.

    The hash takes every column, so copies of a text with other ids scatter too. Rows equal in all columns scatter by a number
    of their own where more than ``REPEATS`` share a hash: since they are interchangeable, they are counted and made again, so
    no task holds them all. Pass two sorts a bucket by that hash before shuffling it, so a task that runs again deals the same
    order. Columns of docs named shard or slot are replaced. Null values hash like any value; an empty table gives no rows.
    The two passes read docs twice; the second shuffles each row once. Only a bucket's rows are ever held together; equal rows
    with a map among their columns, which cannot be compared, share a bucket.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    names = docs.columns
    scratch = Scratch(spark, "shards")
    weight = F.coalesce(F.octet_length(size_col), F.lit(0)) + 64 if size_col else F.lit(256)
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight.cast("long")), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(n, max(-(-total // bucket_bytes), 8 * parts)))
    # maps cannot be hashed; every other type can
    hashed = [c for c, t in docs.dtypes if not t.startswith("map") and "map<" not in t] or [F.lit(0)]
    key = F.xxhash64(F.lit(seed), *hashed)
    dealt = docs.withColumn("_key", key)
    keys = scratch.put(dealt.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")))
    often = keys.where(F.col("_n") > REPEATS).select("_key")
    if len(hashed) == len(names) and often.limit(1).count():
        dealt = _spread(dealt, broadcast_if_small(scratch.put(often), 1 << 17), names)
        keys = scratch.put(dealt.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")))
    bucket = F.pmod("_key", F.lit(buckets))
    dealt = dealt.withColumn("_bucket", bucket)

    counts = keys.groupBy(bucket.alias("_bucket")).agg(F.sum("_n").alias("_n")).withColumn("_block", F.floor(F.col("_bucket") / BLOCK))
    counts = scratch.put(counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_block").orderBy("_bucket")) - F.col("_n")))
    block = counts.groupBy("_block").agg(F.sum("_n").alias("_bn"))
    block = block.withColumn("_base", F.sum("_bn").over(Window.orderBy("_block")) - F.col("_bn"))
    offsets = scratch.put(counts.join(block, "_block").select("_bucket", (F.col("_base") + F.col("_before")).alias("_from")))

    dealt = dealt.join(broadcast_if_small(offsets, 1 << 20), "_bucket")
    dealt = dealt.repartition(max(1, min(buckets, 4 * parts)), "_bucket").sortWithinPartitions("_bucket", "_key", *[c for c, t in docs.dtypes if t in ("bigint", "int", "string")])
    schema = T.StructType([*docs.schema.fields, T.StructField("_place", T.LongType())])

    def second_pass(batches):
        held: list[pa.RecordBatch] = []

        def deal():
            whole = pa.Table.from_batches(held)
            order = _fisher_yates(whole.num_rows, seed, whole.column("_bucket")[0].as_py())
            base = whole.column("_from")[0].as_py()
            out = whole.select(names).take(pa.array(order)).append_column("_place", pa.array(np.arange(base, base + len(order))))
            held.clear()
            return out.to_batches()

        for batch in batches:
            ids = batch.column("_bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[-1].column("_bucket")[0].as_py() != ids[a]:
                    yield from deal()
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from deal()

    out = dealt.mapInArrow(second_pass, schema)
    shard = F.expr(f"_place * {n_shards}L div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_place") - first).drop("_place")


def write_shards(docs: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write shuffle_shards as Parquet, one folder ``shard=k`` each; a bucket lies in few shards, so files stay few."""
    shuffle_shards(docs, n_shards, **options).write.mode("overwrite").partitionBy("shard").parquet(path)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shuffle_shards(docs.select("doc_id", "text"), 24, size_col="text")
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
