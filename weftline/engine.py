"""The commands as functions: context, compare, validate, security scan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.paths import folder
from weftline.operators import contract as C
from weftline.operators import bundle, extract, graph, scan, style
from weftline.sources.files import MAX_BYTES, read_sources
from weftline.storage import Scratch


@dataclass(frozen=True)
class Options:
    depth: int = 2
    max_nodes: int | None = 100
    include_style: bool = False
    strict: bool = False


PROFILES = {"llm-chat": Options(), "llm-safe": Options(max_nodes=30), "ci-strict": Options(strict=True), "watch-fast": Options()}


@dataclass(frozen=True)
class Context:
    """Tables of one run: contracts(id, …), members(root, id, level), edges(root, src, dst), missing, hashes(root, bundle_hash)."""

    contracts: DataFrame
    members: DataFrame
    edges: DataFrame
    missing: DataFrame
    hashes: DataFrame

    def bundles(self) -> DataFrame:
        """(folder, entry_id, n_nodes, n_edges, n_missing, bundle_hash), one row per root."""
        count = lambda df, name: df.groupBy("root").agg(F.count(F.lit(1)).alias(name))
        out = self.hashes.join(count(self.edges, "n_edges"), "root", "left").join(count(self.missing, "n_missing"), "root", "left").fillna(0, ["n_edges", "n_missing"])
        return out.select(folder(F.col("root")).alias("folder"), F.col("root").alias("entry_id"), "n_nodes", "n_edges", "n_missing", "bundle_hash")

    def bundle_rows(self, sources: DataFrame, depth: int, mode: str = "none", **options) -> DataFrame:
        """(entry_id, bundle): whole bundles, with code of sources(path, text) as the mode asks; options as of bundle.bundle_rows()."""
        return bundle.bundle_rows(self.members, self.edges, self.missing, self.hashes, self.contracts, sources, depth, mode, **options)

    def unreached(self) -> DataFrame:
        """(id): files that no root leads to within the depth, such as those that only use each other or themselves."""
        return self.contracts.select("id").join(self.members.select("id"), "id", "left_anti")

    def stats(self) -> DataFrame:
        """One row: contracts, bundles, nodes, edges, missing."""
        b = self.bundles().agg(F.count(F.lit(1)).alias("bundles"), F.sum("n_nodes").alias("nodes"), F.sum("n_edges").alias("edges"), F.sum("n_missing").alias("missing"))
        return self.contracts.agg(F.count(F.lit(1)).alias("contracts")).join(F.broadcast(b))  # one row each


def contracts_of(sources: DataFrame, include_style: bool = False) -> DataFrame:
    """sources(path, text) to contract rows by id, with their hashes."""
    found = C.with_hashes(extract.contracts(sources)).join(sources.select("path", scan.file_hash(F.col("text")).alias("file_hash")), "path")
    if include_style:
        found = found.join(style.style(sources), "path")
    return found.withColumnRenamed("path", "id")


def names_used(contracts: DataFrame) -> DataFrame:
    """(src, name): the components that each file takes from elsewhere."""
    names = C.without_internal(F.col("components"), F.col("functions"), F.col("exports"))
    return contracts.select(F.col("id").alias("src"), F.explode(names).alias("name"))


def edges_of(uses: DataFrame) -> DataFrame:
    """(src, dst) of resolved uses. A file that uses itself keeps that edge, so it is no root."""
    return uses.where("dst is not null").select("src", "dst").distinct()


def missing_of(members: DataFrame, uses: DataFrame, contracts: DataFrame, depth: int) -> DataFrame:
    return C.missing_from_outside(graph.missing(members, uses, depth), contracts.select("id", "components", "functions"))


def context_of(sources: DataFrame, options: Options = Options()) -> Context:
    """Bundles of all roots among sources(path, text), searched at once."""
    scratch = Scratch(sources.sparkSession, "context")
    contracts = scratch.put(contracts_of(sources, options.include_style))
    uses = scratch.put(graph.resolve_dependency(names_used(contracts), contracts.select(F.col("id").alias("path"))))
    edges = edges_of(uses)
    roots = graph.roots(contracts.select("id"), edges)
    members = scratch.put(graph.reach(roots, edges, options.depth, options.max_nodes))
    missing = missing_of(members, uses, contracts, options.depth)
    if options.strict and missing.limit(1).count():
        raise ValueError("dependencies are missing")
    hashed = members.join(contracts.select("id", "semantic_hash"), "id")
    return Context(contracts, members, graph.bundle_edges(members, edges), missing, graph.bundle_hash(hashed, options.depth))


def context(spark: SparkSession, root: str, options: Options | str = Options(), **changes) -> Context:
    """Context of the source tree below root; options may name a profile."""
    options = PROFILES[options] if isinstance(options, str) else options
    return context_of(read_sources(spark, root), replace(options, **changes))


def compare(old: Context, new: Context) -> DataFrame:
    """(id, op, facet) between the contracts of two runs: ids without case, props and events by name, exports by kind."""
    facets = ["semantic_hash", "imports", "hooks", "functions", "components", "props", "emits", "exports"]
    names = lambda c: F.array_sort(F.transform(c, lambda x: x["name"])).alias(c)

    def side(run: Context) -> DataFrame:
        return run.contracts.select(F.lower("id").alias("id"), *[F.col("exports.form").alias(c) if c == "exports" else names(c) if c in ("props", "emits") else F.col(c) for c in facets])

    return graph.diff(side(old), side(new), "id", facets)


def validate(bundles: DataFrame, bundle_type: str, contract_type: str = C.CONTRACT) -> DataFrame:
    """(rule, severity, n) of the rules that bundles of the expected types break."""
    return C.validate(bundles, bundle_type, contract_type)


def security_scan(spark: SparkSession, root: str) -> DataFrame:
    """Every secret in files of at most MAX_BYTES below root, false positives left out."""
    files = read_sources(spark, root, ("ts", "tsx", "js", "jsx", "json"), MAX_BYTES)
    return scan.all_secret_matches(files.withColumnRenamed("path", "id"))
