"""Whole bundles: one nested row per root, with contracts, edges, missing names and the code that a mode asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import sorted_by_name
from weftline.functions.paths import package_name
from weftline.operators import contract as C
from weftline.operators.report import mask_by_report
from weftline.operators.scan import HEADER_BLOCK, file_hash, mask_all
from weftline.storage import Scratch

MODES = ("none", "header", "full")


class HashLockError(ValueError):
    """Files have changed since their contracts were made."""


def code_of(sources: DataFrame, mode: str, report: DataFrame | None = None, report_root: str = ".", root: str = ".") -> DataFrame:
    """sources(path, text) to (id, code_header, code) as the mode asks; secrets are masked before anything is taken.

    With a report its matches are masked, else everything that looks like a secret.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    masked = mask_by_report(sources, report, report_root, root).select("path", "masked") if report is not None else sources.select("path", mask_all(F.col("text")).alias("masked"))
    none = F.lit(None).cast("string")
    header = F.nullif(F.regexp_extract("masked", HEADER_BLOCK, 1), F.lit(""))
    return masked.select(F.col("path").alias("id"), (none if mode == "none" else header).alias("code_header"), (F.col("masked") if mode == "full" else none).alias("code"))


def broken_locks(contracts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id): contracts whose file hash is not that of their source now, or whose source is gone."""
    now = sources.select(F.col("path").alias("id"), file_hash(F.col("text")).alias("_now"))
    return contracts.select("id", "file_hash").join(now, "id", "left").where("not (file_hash <=> _now)").select("id")


def bundle_rows(
    members: DataFrame, edges: DataFrame, missing: DataFrame, hashes: DataFrame, contracts: DataFrame, sources: DataFrame, depth: int, mode: str = "none", sidecars: DataFrame | None = None,
    versions: DataFrame | None = None, hash_lock: bool = False, bundle_type: str = "Bundle", report: DataFrame | None = None, report_root: str = ".", root: str = ".",
) -> DataFrame:
    """(entry_id, bundle): bundle is a struct of type, schemaVersion, entryId, depth, bundleHash, graph(nodes, edges), meta(missing).

    A node's contract is the one of this run, else its sidecar's; a node with neither is named as missing. Nodes and edges stand
    in collated order. A missing name that is a package has the package and its version. With hash_lock contracts whose file
    has changed raise an error. Code is made once for each file; a bundle has as many nodes as the search allowed.
    """
    scratch = Scratch(members.sparkSession, "bundles")
    shown = [c for c in ("kind", "description", "semantic_hash", "file_hash") if c in contracts.columns]

    def contract(df: DataFrame) -> DataFrame:
        return df.select("id", F.struct(F.lit(C.CONTRACT).alias("type"), F.lit(C.CONTRACT_VERSION).alias("schemaVersion"), F.col("id").alias("entryId"), *shown).alias("contract"))

    if hash_lock and broken_locks(contracts, sources).limit(1).count():
        raise HashLockError("files have changed since their contracts were made")
    known = contract(contracts)
    if sidecars is not None:
        known = known.unionByName(contract(sidecars.join(contracts.select("id"), "id", "left_anti")))
    node = scratch.put(known.join(code_of(sources, mode, report, report_root, root), "id", "left"))
    nodes = members.select("root", "id").join(node, "id", "left")
    gone = nodes.where("contract is null").select("root", F.col("id").alias("name"), F.lit("no contract").alias("reason"), F.lit(None).cast("string").alias("referenced_by"))
    gone = gone.unionByName(missing.select("root", "name", F.lit("not found").alias("reason"), "referenced_by")).withColumn("package", package_name(F.col("name")))
    if versions is not None:
        gone = gone.join(versions.select(F.col("name").alias("package"), "version").dropDuplicates(["package"]), "package", "left")
    else:
        gone = gone.withColumn("version", F.lit(None).cast("string"))

    def held(df: DataFrame, row: Column, name: str) -> DataFrame:
        return df.groupBy("root").agg(F.collect_list(row).alias(name))

    kept = held(nodes.where("contract is not null"), F.struct(F.col("id").alias("entryId"), "contract", F.col("code_header").alias("codeHeader"), "code"), "nodes")
    out = kept.join(held(edges, F.struct("src", "dst"), "edges"), "root", "left").join(held(gone, F.struct("name", "reason", F.col("referenced_by").alias("referencedBy"), F.col("package").alias("packageName"), F.col("version").alias("packageVersion")), "missing"), "root", "left")
    out = out.join(hashes.select("root", "bundle_hash"), "root", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    pairs = F.transform(sorted_by_name(F.col("edges"), lambda e: F.concat(e["src"], F.lit("\u0001"), e["dst"])), lambda e: F.array(e["src"], e["dst"]))
    gone_kind = "array<struct<name:string,reason:string,referencedBy:string,packageName:string,packageVersion:string>>"
    graph = F.struct(sorted_by_name(F.col("nodes"), lambda n: n["entryId"]).alias("nodes"), empty(pairs, "array<array<string>>").alias("edges"))
    meta = F.struct(empty(F.array_sort("missing"), gone_kind).alias("missing"))
    bundle = F.struct(F.lit(bundle_type).alias("type"), F.lit(C.BUNDLE_VERSION).alias("schemaVersion"), F.col("root").alias("entryId"), F.lit(depth).alias("depth"), F.col("bundle_hash").alias("bundleHash"), graph.alias("graph"), meta.alias("meta"))
    return out.select(F.col("root").alias("entry_id"), bundle.alias("bundle"))
