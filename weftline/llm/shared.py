"""Shared-folder tables, bounds on Arrow batches and connected components."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import storage
from weftline.storage import broadcast_if_small, shared_dir  # noqa: F401

BATCH_BYTES = 4 << 20  # of an Arrow batch between the JVM and a Python worker; the default of 10000 rows of text is too much


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, unless the session has a smaller bound: rows of text are of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([a-z]*)", str(spark.conf.get(key, "64MB")).lower())
    unit = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20}.get(now[2]) if now else None
    if unit is None or int(now[1]) * unit > most:
        spark.conf.set(key, str(most))


class Scratch(storage.Scratch):
    """Tables in the shared folder, written and read in small batches."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        super().__init__(spark, name)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (id, component) per endpoint, component = smallest id reachable.

    Each round every vertex points at its smallest neighbour (or itself), pointers are jumped to their roots and the
    edges are contracted to roots, which at least halves the number of vertices with edges. No edge reaches the driver.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = None
    while True:
        parent = scratch.put(both(edges).groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("p")))
        while True:  # jump pointers until every vertex points at a root
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.put(parent.join(up, "p").select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            scratch.drop(parent)
            parent = jumped
            if not moved:
                break
        parent = parent.select("id", "p")
        if total is None:
            total = parent
        else:
            total = scratch.put(total.join(parent.select(F.col("id").alias("p"), F.col("p").alias("np")), "p", "left").select("id", F.coalesce("np", "p").alias("p")))
        root = lambda c: parent.select(F.col("id").alias(c), F.col("p").alias(f"{c}_root"))
        left = edges.join(root("a"), "a").join(root("b"), "b").where("a_root <> b_root")
        left = scratch.put(left.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        edges = left
        if not edges.limit(1).count():
            return total.select("id", F.col("p").alias("component"))
