"""Writers and formats: bundles per folder, the index over folders, security reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import compact
from weftline.functions.paths import root_label
from weftline.operators.scan import tokens_claude, tokens_gpt
from weftline.storage import Scratch

SCHEMA_URL = "https://example.org/schemas/context/v0.1.json"
FORMATS = ("json", "ndjson", "pretty", "toon")


def with_places(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with place (from 1, by order) and _n (rows) within its group, where a group may hold any share of the rows.

    Rows are sorted in ranges and written; a range's place in its group is the rows of the ranges before it, so that no task
    sees more than its range. Rows of one group and order stand in one range. A null group is a group, with null order first.
    """
    scratch = Scratch(df.sparkSession, "places")
    ranged = scratch.put(df.repartitionByRange(group, order).withColumn("_slice", F.spark_partition_id()))
    counts = ranged.groupBy(F.col(group).alias("_g"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_rows"))
    of = Window.partitionBy("_g")  # as many rows as a group has ranges
    counts = counts.select("_g", "_s", (F.sum("_rows").over(of.orderBy("_s")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(of).alias("_n"))
    row = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order))
    out = ranged.withColumn("_row", row).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
    return out.select(*df.columns, (F.col("_before") + F.col("_row")).alias("place"), "_n")


def format_bundles(bundles: DataFrame, fmt: str = "json", order: str = "entry_id", schema_url: str = SCHEMA_URL) -> DataFrame:
    """bundles (folder and any columns) to (folder, place, line): each bundle as JSON with its position i/n in its folder.

    ndjson: one line each; pretty: a heading line before indented JSON; json: members of an array; toon: the compact form.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    placed = with_places(bundles, "folder", order)
    position = F.concat_ws("/", F.col("place").cast("string"), F.col("_n").cast("string"))
    row = F.struct(F.lit(schema_url).alias("$schema"), position.alias("position"), *[c for c in bundles.columns if c != "folder"])
    if fmt == "toon":
        text = compact.encode(row, placed.select(row.alias("r")).schema["r"].dataType)
    else:
        text = F.to_json(row, {"pretty": "true"}) if fmt in ("json", "pretty") else F.to_json(row)
    if fmt == "pretty":
        text = F.concat(F.lit("\n# Bundle "), position, F.lit(": "), F.col(order).cast("string"), F.lit("\n"), text)
    if fmt == "json":
        text = F.concat(F.when(F.col("place") == 1, "[\n").otherwise(""), text, F.when(F.col("place") == F.col("_n"), "\n]").otherwise(","))
    return placed.select("folder", "place", text.alias("line"))


def write_context(bundles: DataFrame, path: str, fmt: str = "json", order: str = "entry_id") -> None:
    """Lines of each folder below path/folder=…, in order over its part files by name; a large folder has several."""
    lines = format_bundles(bundles, fmt, order)
    lines.repartitionByRange("folder", "place").sortWithinPartitions("folder", "place").select("folder", "line").write.mode("overwrite").partitionBy("folder").text(path)


def index(bundles: DataFrame, text: Column) -> DataFrame:
    """(folder, bundles, gpt, claude, root_label): one row per folder for the main index; text is what a bundle is written as."""
    sums = bundles.groupBy("folder").agg(F.count(F.lit(1)).alias("bundles"), F.sum(tokens_gpt(text)).alias("gpt"), F.sum(tokens_claude(text)).alias("claude"))
    return sums.withColumn("root_label", root_label(F.col("folder")))


def write_index(folders: DataFrame, path: str) -> None:
    """One JSON line per folder, in ranges of folders in order."""
    folders.orderBy("folder").write.mode("overwrite").json(path)


def security_report(matches: DataFrame) -> DataFrame:
    """(file, secrets, high): one row per file with matches(id, severity)."""
    return matches.groupBy(F.col("id").alias("file")).agg(F.count(F.lit(1)).alias("secrets"), F.count_if(F.col("severity") == "high").alias("high"))


def write_security_report(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").json(path)


def read_security_report(spark, path: str) -> DataFrame:
    return spark.read.schema("id string, line bigint, column bigint, type string, severity string, snippet string").json(path)


def append_log(log: DataFrame, entries: DataFrame, keep: int = 100) -> DataFrame:
    """Log and new entries (ts first among their columns), the newest `keep` of both."""
    return log.unionByName(entries).orderBy(F.desc("ts"), *[F.desc(c) for c in log.columns if c != "ts"]).limit(keep)
