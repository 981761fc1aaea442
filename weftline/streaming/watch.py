"""Watching a stream of changes: debounced batches by session window, keyed upserts and rebuilds by foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.storage import delete, exists

BUCKETS = 64


def should_trigger(path: Column, extensions: tuple[str, ...] = ("ts", "tsx"), style: bool = False) -> Column:
    """Whether a changed path matters: a file of these extensions (style sheets too, if asked for) or the ignore list."""
    known = (*extensions, *(("css", "scss") if style else ()))
    return path.rlike(rf"\.({'|'.join(known)})$") | path.rlike(r"(^|/)\.[a-z]*ignore$")


def debounce(changes: DataFrame, key: str, gap: str = "500 milliseconds", late: str | None = "1 minute", path: str | None = None) -> DataFrame:
    """One row per burst of changes of a key, with its distinct paths if asked for; for streams, late is the watermark that closes a burst."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    what = [F.count(F.lit(1)).alias("n"), *([F.array_sort(F.collect_set(path)).alias("paths")] if path else [])]
    return changes.groupBy(key, F.session_window("ts", gap)).agg(*what)


def fresh(batch: DataFrame, known: DataFrame | None, key: str, hash_col: str = "file_hash") -> DataFrame:
    """The newest row of each key in a batch, if its hash is not the one known."""
    last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct("ts", hash_col)).alias("r")).select("r.*")
    return last if known is None else last.join(known.select(key, hash_col), [key, hash_col], "left_anti")


def read_table(spark, path: str, schema=None) -> DataFrame | None:
    """The table that upsert_to() keeps, or None before its first batch."""
    if not exists(spark, path):
        return None
    out = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    return out.drop("_bucket")


def upsert_to(path: str, key: str, hash_col: str = "file_hash", then: Callable[[DataFrame, int], None] | None = None):
    """A foreachBatch function: rows of the batch whose hash is new replace those of the same key in the table at path.

    Only buckets of keys that changed are rewritten, from a copy written first, so that a batch that runs again after a
    failure finds its rows known or writes them again: the result is the same. then(changed rows, epoch) runs after that.
    """
    bucket = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        spark, staged = batch.sparkSession, f"{path}.staged/{epoch}"
        old = spark.read.parquet(path) if exists(spark, path) else None
        if not exists(spark, f"{staged}/changed/_SUCCESS"):  # else an attempt before this one has found them
            fresh(batch, old, key, hash_col).withColumn("_bucket", bucket).write.mode("overwrite").parquet(f"{staged}/changed")
        changed = spark.read.parquet(f"{staged}/changed")
        if old is not None:
            touched = [r["_bucket"] for r in changed.select("_bucket").distinct().collect()]  # BUCKETS numbers at most
            kept = old.where(F.col("_bucket").isin(touched or [-1])).join(changed.select(key), key, "left_anti")
            changed_all = kept.select(changed.columns).unionByName(changed)
        else:
            changed_all = changed
        changed_all.write.mode("overwrite").parquet(f"{staged}/whole")
        whole = spark.read.parquet(f"{staged}/whole")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
        if then is not None:
            then(changed.drop("_bucket"), epoch)
        delete(spark, staged)

    return write


def affected(members: DataFrame, changed: DataFrame, new_roots: DataFrame) -> DataFrame:
    """Roots to pack again: those whose bundle holds a changed id, and the new ones; all three (id or root)."""
    return graph.affected_roots(members, changed).union(new_roots.select("root")).distinct()


def strict_counts(violations: DataFrame, by: str = "epoch") -> DataFrame:
    """(by, errors, warnings, errors_so_far, warnings_so_far) over rows (by, severity); one row per batch is summed up in order."""
    from pyspark.sql import Window

    n = violations.groupBy(by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    upto = Window.orderBy(by)
    return n.withColumns({"errors_so_far": F.sum("errors").over(upto), "warnings_so_far": F.sum("warnings").over(upto)})


def start(sources: DataFrame, table: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, once: bool = False):
    """Watch a stream (path, text, ts): keep its newest texts in the table at `table`, hand changed rows to then.

    A query that starts again with the same checkpoint goes on where it was; the table is the snapshot to rebuild from.
    """
    from weftline.operators.scan import file_hash

    rows = sources.where(should_trigger(F.col("path"))).withColumn("file_hash", file_hash(F.col("text")))
    writer = rows.writeStream.foreachBatch(upsert_to(table, "path", then=then)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
