"""Readers: source trees, bundles, contracts, indexes, package versions, streams of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.contract import BUNDLE_SCHEMA

MAX_BYTES = 10 << 20  # of a file that is scanned for secrets
SKIP = r"/(node_modules|dist|build|\.next|coverage)/|\.(test|spec)\.tsx?$"
CONTRACT_SCHEMA = "type string, schemaVersion string, kind string, entryId string, description string, semanticHash string, fileHash string"
INDEX_SCHEMA = "type string, schemaVersion string, createdAt string, summary map<string,bigint>, folders array<struct<path:string,contextFile:string,bundles:bigint,isRoot:boolean,rootLabel:string>>"


def _paths(raw: DataFrame, *columns: str) -> DataFrame:
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/").alias("path"), *columns)


def read_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("ts", "tsx"), max_bytes: int | None = None) -> DataFrame:
    """Whole text files below root as (path, text), without build and test files; only matching files are opened."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").option("wholetext", True).format("text").load(root)
    if max_bytes is not None:
        raw = raw.where(F.col("_metadata.file_size") <= max_bytes)
    return _paths(raw.withColumnRenamed("value", "text"), "text").where(~F.col("path").rlike(SKIP))


def stream_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("ts", "tsx"), max_files: int = 1000) -> DataFrame:
    """The same as a stream: files that are added or, under a new name or time, changed. Deletions do not come as rows."""
    raw = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").option("wholetext", True).option("maxFilesPerTrigger", max_files).format("text").load(root)
    time = F.col("_metadata.file_modification_time").alias("ts")
    return _paths(raw.withColumnRenamed("value", "text").withColumn("ts", time), "text", "ts").where(~F.col("path").rlike(SKIP))


def _json(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(root)
    return found.withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")).where(~F.col("path").rlike(r"/(node_modules|dist|build|\.next|coverage)/"))


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Bundles of all context.json files below root, with path and folder; arrays become rows. Broken files give null fields."""
    return _json(spark, root, "context.json", BUNDLE_SCHEMA).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))


def read_contracts(spark: SparkSession, root: str) -> DataFrame:
    """Contracts beside their files (name.uif.json); what cannot be read is left out."""
    return _json(spark, root, "*.uif.json", CONTRACT_SCHEMA).where("entryId is not null")


def read_index(spark: SparkSession, path: str, index_type: str) -> DataFrame:
    """(folder, context_file, bundles, is_root, root_label, known): an index's folders; known is false for a type or version not known."""
    rows = spark.read.option("multiLine", True).schema(INDEX_SCHEMA).json(path)
    known = F.coalesce((F.col("type") == index_type) & F.col("schemaVersion").isin("0.1", "0.2"), F.lit(False))
    return rows.select(F.explode("folders").alias("f"), known.alias("known")).select(F.col("f.path").alias("folder"), F.col("f.contextFile").alias("context_file"), "f.bundles", F.col("f.isRoot").alias("is_root"), F.col("f.rootLabel").alias("root_label"), "known")


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """manifests(path, text) of a project's stored graph to (path, version, key, component): component is a VARIANT, of any shape.

    A text that is no JSON, or has no components, gives one row with a null key. component_fields() takes the usual fields out.
    """
    spark = manifests.sparkSession
    parsed = manifests.select("path", F.try_parse_json("text").alias("v"))
    each = spark.tvf.variant_explode_outer(F.try_variant_get(F.col("v").outer(), "$.components", "variant"))
    out = parsed.lateralJoin(each)
    return out.select("path", F.try_variant_get("v", "$.version", "string").alias("version"), F.col("key"), F.col("value").alias("component"))


def component_fields(rows: DataFrame) -> DataFrame:
    """manifest_rows with the fields of a component as columns; those that are missing or of another type are null."""
    get = lambda path, kind: F.try_variant_get("component", f"$.{path}", kind)
    return rows.select(
        "path", "version", "key", get("entryId", "string").alias("entry_id"), get("description", "string").alias("description"), get("dependencies", "array<string>").alias("dependencies"),
        get("usedBy", "array<string>").alias("used_by"), get("imports", "array<string>").alias("imports"), get("routes", "array<string>").alias("routes"), get("semanticHash", "string").alias("semantic_hash"),
    )


def read_manifests(spark: SparkSession, root: str, name: str) -> DataFrame:
    """component_fields of all manifests of that file name below root."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("wholetext", True).format("text").load(root)
    return component_fields(manifest_rows(_paths(raw.withColumnRenamed("value", "text"), "text")))


def package_versions(manifests: DataFrame) -> DataFrame:
    """manifests(root, text of package.json) to (root, name, version): dependencies before devDependencies before peerDependencies."""
    kinds = ("dependencies", "devDependencies", "peerDependencies")
    parsed = manifests.select("root", F.from_json("text", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("p"))
    each = parsed.select("root", F.inline(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"p.{k}").alias("m")) for r, k in enumerate(kinds)])))
    return each.select("root", "r", F.explode("m").alias("name", "version")).groupBy("root", "name").agg(F.min_by("version", "r").alias("version"))


def with_versions(imports: DataFrame, versions: DataFrame) -> DataFrame:
    """imports(id, root, package) with the version of the package in its root, or null."""
    return imports.join(versions.withColumnRenamed("name", "package"), ["root", "package"], "left")


def newest(rows: DataFrame, key: str, time: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).where("_r = 1").drop("_r")
