"""Dependency graphs over edges(src, dst) and nodes(id): users, roots, leaves, name resolution, bounded search, bundles, diffs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.canonical import sorted_by_name
from weftline.functions.paths import CODE, code_stem, normalize, parent, stem
from weftline.storage import Scratch, broadcast_if_small


def used_by(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_users"), F.min("src").alias("first_user"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def _rank(path: Column) -> Column:
    return F.when(path.endswith(".tsx"), 0).when(path.endswith(".ts"), 1).otherwise(2)


def resolve(names: DataFrame, files: DataFrame) -> DataFrame:
    """Name to file: .tsx before .ts before any other base name, then smallest path. names(name), files(path)."""
    by_name = files.groupBy(stem(F.col("path")).alias("name")).agg(F.min_by("path", F.struct(_rank(F.col("path")), "path")).alias("path"))
    return names.join(by_name, "name", "left")


def resolve_key(keys: DataFrame, files: DataFrame) -> DataFrame:
    """keys(key) to (key, path): the exact path, else one equal after normalising, else the first file of that name.

    A file's name is its base name without .ts, .tsx, .js or .jsx; a key means it as it stands or without such an ending. Of
    several files the first in order of paths counts, whatever its ending.
    """
    exact = files.select(F.col("path").alias("key"), F.col("path").alias("_exact")).distinct()
    equal = files.groupBy(F.lower(normalize(F.col("path"))).alias("_norm")).agg(F.min("path").alias("_equal"))
    named = files.groupBy(code_stem(F.col("path")).alias("_stem")).agg(F.min("path").alias("_named"))
    bare = named.select(F.col("_stem").alias("_bare"), F.col("_named").alias("_of_bare"))
    out = keys.withColumns({"_norm": F.lower(normalize(F.col("key"))), "_stem": F.col("key"), "_bare": F.regexp_replace("key", CODE, "")})
    out = out.join(exact, "key", "left").join(equal, "_norm", "left").join(named, "_stem", "left").join(bare, "_bare", "left")
    return out.select(*keys.columns, F.coalesce("_exact", "_equal", F.least("_named", "_of_bare")).alias("path"))


def resolve_dependency(uses: DataFrame, files: DataFrame) -> DataFrame:
    """uses(src, name) to (src, name, dst): a sibling of src (name.tsx, name.ts, name/index.tsx, name/index.ts), else resolve_key.

    dst is null if nothing fits. Candidates are an equi-join on normalised paths; no file is compared with every name.
    """
    near = F.array(*[F.struct(F.lit(k).alias("r"), F.lower(normalize(F.concat(parent(F.col("src")), "name", F.lit(end)))).alias("_norm")) for k, end in enumerate((".tsx", ".ts", "/index.tsx", "/index.ts"))])
    equal = files.groupBy(F.lower(normalize(F.col("path"))).alias("_norm")).agg(F.min("path").alias("path"))
    found = uses.distinct().select("src", "name", F.inline(near)).join(equal, "_norm")
    found = found.groupBy("src", "name").agg(F.min_by("path", "r").alias("_near"))
    wide = resolve_key(uses.select(F.col("name").alias("key")).distinct(), files).select(F.col("key").alias("name"), F.col("path").alias("_wide"))
    return uses.join(found, ["src", "name"], "left").join(wide, "name", "left").select("src", "name", F.coalesce("_near", "_wide").alias("dst"))


TWIN_DEGREE = 64  # a root of more successors is its own twin, so that no row holds a large set
TASK_ROWS = 8_000_000  # rows that a task makes when bundles are told for each root
BLOCK_ROWS = 1024  # rows of a twin that are gathered in one
RUN_ROWS = 128  # of these that meet its roots together; a multiple of 8, so that columns packed by bits repeat in whole bytes
MAX_ROOTS = 1 << 20  # roots (about 100 MB) that are broadcast; more meet their rows in slices


@dataclass(frozen=True)
class Reach:
    """Bundles of many roots, told once for roots that lead to the same nodes.

    roots(root, twin); found(twin, id, level, place): what a twin's search reached beyond the twin itself. Both are written.
    Nothing leads to a root that stands for others, so it is in no bundle but its own. Sums, firsts and limits need found
    alone; rows() and edges(), which name every root, are made by a join whose result no shuffle or file holds.
    """

    roots: DataFrame
    found: DataFrame

    def each_root(self, rows: DataFrame) -> DataFrame:
        """rows(twin, ...), read twice, as (root, twin, ...), once for each root of the twin; a hub's roots are spread over many tasks.

        The rows of a twin meet its roots in runs of RUN_ROWS, cut from blocks of some BLOCK_ROWS, and a root has those of a run in
        order, one after the other: a column of a file then repeats one root, or one short list of the rest, which takes a
        fraction of a byte a row.
        """
        scratch = Scratch(rows.sparkSession, "blocks")
        sizes = rows.groupBy("twin").agg(F.count(F.lit(1)).alias("_m")).join(self.roots.groupBy("twin").agg(F.count(F.lit(1)).alias("_n")), "twin")
        sizes = scratch.put(sizes)
        n, total = sizes.agg(F.sum(F.col("_n") * F.col("_m")), F.sum("_n")).first()
        parts, slices = int(n or 0) // TASK_ROWS + 1, -(-int(total or 0) // MAX_ROOTS)
        rest = [c for c in rows.columns if c != "twin"]
        hubs = broadcast_if_small(sizes.where(F.col("_m") > BLOCK_ROWS).select("twin", F.ceil(F.col("_m") / BLOCK_ROWS).alias("_k")), MAX_ROOTS)
        rows = rows.join(hubs, "twin", "left").withColumn("_block", F.pmod(F.xxhash64(*rest), F.coalesce("_k", F.lit(1))))
        if parts > 1:
            rows = rows.repartition(parts, "twin", "_block")
        blocks = rows.groupBy("twin", "_block").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("_rows"))
        starts = F.sequence(F.lit(1), F.size("_rows"), F.lit(RUN_ROWS))
        blocks = blocks.select("twin", F.explode(F.transform(starts, lambda k: F.slice("_rows", k, RUN_ROWS))).alias("_rows"))
        if slices <= 1:
            each = blocks.join(F.broadcast(self.roots), "twin")
        else:
            blocks = blocks.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
            each = blocks.join(self.roots.withColumn("_slice", F.pmod(F.xxhash64("root"), F.lit(slices)).cast("int")), ["twin", "_slice"])
        return each.select("root", "twin", F.inline("_rows"))

    def rows(self, found: DataFrame | None = None) -> DataFrame:
        """(root, id, level, place), the roots themselves at level 0; found: some of the rows of found instead of all."""
        own = self.roots.select("root", F.col("root").alias("id"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("place"))
        return own.union(self.each_root(self.found if found is None else found).select("root", "id", "level", "place"))

    def edges(self, edges: DataFrame) -> DataFrame:
        """bundle_edges of all roots."""
        twins = self.roots.select(F.col("twin").alias("root"), F.col("twin").alias("id")).distinct()
        inner = bundle_edges(self.found.select(F.col("twin").alias("root"), "id").union(twins), edges).withColumnRenamed("root", "twin")
        inner = Scratch(edges.sparkSession, "inner").put(inner)
        return self.each_root(inner).select("root", F.when(F.col("src") == F.col("twin"), F.col("root")).otherwise(F.col("src")).alias("src"), "dst")

    def missing(self, uses: DataFrame, depth: int) -> DataFrame:
        """missing() of all roots."""
        lost = uses.where("dst is null").select(F.col("src").alias("id"), "name").distinct()
        order = F.struct("level", "place", "id").alias("_o")
        found = self.found.where(F.col("level") < depth).join(lost, "id").groupBy("twin", "name").agg(F.min(order).alias("_o"))
        own = self.roots.select("root", F.col("root").alias("id"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("place")).where(F.col("level") < depth).join(lost, "id").select("root", "name", order)
        each = self.each_root(Scratch(uses.sparkSession, "lost").put(found)).select("root", "name", "_o").union(own)
        return each.groupBy("root", "name").agg(F.min("_o").alias("_o")).select("root", "name", F.col("_o.id").alias("referenced_by"))

    def affected_roots(self, changed: DataFrame) -> DataFrame:
        """affected_roots() of all roots."""
        twins = self.found.join(changed, "id", "left_semi").select("twin").distinct()
        own = self.roots.join(changed.select(F.col("id").alias("root")), "root", "left_semi").select("root")
        return self.roots.join(twins, "twin", "left_semi").select("root").union(own).distinct()

    def reverse_index(self) -> DataFrame:
        """reverse_index() of all roots."""
        sizes = self.roots.groupBy("twin").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("first"))
        each = self.found.join(sizes, "twin").select("id", "n", "first").union(self.roots.select("root", F.lit(1).cast("long"), "root"))
        return each.groupBy("id").agg(F.sum("n").alias("n_roots"), F.min("first").alias("first_root"))

    def totals(self) -> DataFrame:
        """One row: n_bundles, n_nodes over all of them, depth of the deepest."""
        sizes = self.roots.groupBy("twin").agg(F.count(F.lit(1)).alias("n"))
        held = self.found.groupBy("twin").agg(F.count(F.lit(1)).alias("m"), F.max("level").alias("l"))
        each = sizes.join(held, "twin", "left").select("n", (F.col("n") * (1 + F.coalesce("m", F.lit(0)))).alias("nodes"), F.coalesce("l", F.lit(0)).alias("l"))
        return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bundles"), F.sum("nodes").alias("n_nodes"), F.max("l").alias("depth"))


def twins(scratch: Scratch, starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, twin): of starts that no edge leads to and that lead to the same nodes, the smallest is the twin of all; others are their own."""
    starts = scratch.put(starts.select("id").distinct())
    out = scratch.put(starts.join(edges.withColumnRenamed("src", "id"), "id"))
    few = out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= TWIN_DEGREE)
    entered = starts.join(edges.select(F.col("dst").alias("id")), "id").distinct()
    sets = out.join(few, "id", "left_semi").join(entered, "id", "left_anti").groupBy("id").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    sets = scratch.put(sets)
    same = sets.join(sets.groupBy("to").agg(F.min("id").alias("twin")), "to").select("id", "twin")
    return scratch.put(starts.join(same, "id", "left").select(F.col("id").alias("root"), F.coalesce("twin", "id").alias("twin")))


def search(starts: DataFrame, edges: DataFrame, depth: int, max_nodes: int | None = None) -> Reach:
    """The nodes within depth steps of each root, at their smallest level; all twins in one search.

    Every level is written once and meets the written edges; what was seen before is one table that grows. With max_nodes
    a search stops at so many nodes, in breadth-first order: by the place of the node that leads there, then by id.
    """
    scratch = Scratch(starts.sparkSession, "reach")
    edges = scratch.put(edges.select("src", "dst").distinct())
    roots = twins(scratch, starts, edges)
    seen = level = scratch.put(roots.select("twin").distinct().select("twin", F.col("twin").alias("id"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("place")))
    for k in range(1, depth + 1):
        step = level.select("twin", F.col("id").alias("src"), "place").join(edges, "src").groupBy("twin", F.col("dst").alias("id")).agg(F.min("place").alias("_from"))
        step = step.join(seen.select("twin", "id"), ["twin", "id"], "left_anti").withColumn("level", F.lit(k))
        if max_nodes is None:
            step = step.select("twin", "id", "level", F.lit(1).cast("long").alias("place"))
        else:
            sizes = seen.groupBy("twin").agg(F.count(F.lit(1)).alias("_n"))
            order = F.row_number().over(Window.partitionBy("twin").orderBy("_from", "id"))
            step = step.withColumn("_o", order).where(F.col("_o") <= max_nodes).join(sizes, "twin")
            step = step.withColumn("place", (F.col("_n") + F.col("_o")).cast("long")).where(F.col("place") <= max_nodes).select("twin", "id", "level", "place")
        level = scratch.put(step)
        seen = seen.union(level)
    return Reach(roots, seen.where("level > 0"))


def reach(starts: DataFrame, edges: DataFrame, depth: int, max_nodes: int | None = None) -> DataFrame:
    """(root, id, level), with max_nodes also place: the rows of a search."""
    rows = search(starts, edges, depth, max_nodes).rows()
    return rows.select("root", "id", "level") if max_nodes is None else rows


def missing(members: DataFrame, uses: DataFrame, depth: int) -> DataFrame:
    """(root, name, referenced_by): unresolved names of the nodes a search went on from, each with its first referencer.

    members as of reach(); uses(src, name, dst) with a null dst where a name was not found.
    """
    order = [c for c in ("level", "place", "id") if c in members.columns]
    lost = uses.where("dst is null").select(F.col("src").alias("id"), "name").distinct()
    found = members.where(F.col("level") < depth).join(lost, "id")
    return found.groupBy("root", "name").agg(F.min_by("id", F.struct(*order)).alias("referenced_by"))


def bundle_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are in the same bundle: members(root, id), a written table."""
    out = members.select("root", F.col("id").alias("src")).join(edges, "src")
    return out.join(members.select("root", F.col("id").alias("dst")), ["root", "dst"], "left_semi").select("root", "src", "dst")


def bundle_hash(members: DataFrame, depth: int, version: str = "0.1", slices: int | None = None) -> DataFrame:
    """uifb: hash over the (id, semantic_hash) pairs of each bundle in collated order, its depth and the schema version.

    A bundle becomes one text of a few hundred bytes a node. For bundles that do not fit a row, slices deals the ids into so
    many parts whose hashes are hashed: another value, but no row holds a bundle whole.
    """
    tail = F.lit(f',"schemaVersion":"{version}"}}')
    short = lambda text: F.concat(F.lit("uifb:"), F.substring(F.sha2(text, 256), 1, 24)).alias("bundle_hash")
    pairs = F.collect_list(F.struct(F.col("id").alias("entryId"), F.col("semantic_hash").alias("semanticHash")))
    nodes = lambda held: F.to_json(sorted_by_name(held, lambda x: x["entryId"]))
    if slices is None:
        whole = members.groupBy("root").agg(pairs.alias("_p"), F.count(F.lit(1)).alias("n_nodes"))
        return whole.select("root", "n_nodes", short(F.concat(F.lit(f'{{"depth":{depth},"nodes":'), nodes(F.col("_p")), tail)))
    each = members.groupBy("root", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(slices)).alias("slice")).agg(pairs.alias("_p"), F.count(F.lit(1)).alias("n"))
    each = each.select("root", "slice", "n", F.sha2(nodes(F.col("_p")), 256).alias("hash"))
    whole = each.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("slice", "hash"))).alias("s"), F.sum("n").alias("n_nodes"))
    return whole.select("root", "n_nodes", short(F.concat(F.lit(f'{{"depth":{depth},"slices":'), F.to_json("s"), tail)))


def diff(old: DataFrame, new: DataFrame, key: str, facets: list[str]) -> DataFrame:
    """(id, op, facet): added, removed, and one changed row per facet that differs; one full outer join.

    Facets may be of any type; maps and structs are compared by their JSON text.
    """
    kinds = dict(old.dtypes)
    value = lambda c: F.to_json(c) if kinds[c].startswith(("map", "struct", "array<struct", "array<map")) else F.col(c)
    o = old.select(key, F.lit(True).alias("_o"), *[value(c).alias(f"o_{c}") for c in facets])
    n = new.select(key, F.lit(True).alias("_n"), *[value(c).alias(f"n_{c}") for c in facets])
    both = o.join(n, key, "full_outer")
    changes = F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.struct(F.lit("changed").alias("op"), F.lit(c).alias("facet"))) for c in facets])
    one = lambda op: F.array(F.struct(F.lit(op).alias("op"), F.lit("entry").alias("facet")))
    rows = F.when(F.col("_o").isNull(), one("added")).when(F.col("_n").isNull(), one("removed")).otherwise(F.array_compact(changes))
    return both.select(F.col(key).alias("id"), F.explode(rows).alias("c")).select("id", "c.op", "c.facet")


def compare_folders(old: DataFrame, new: DataFrame, facets: list[str]) -> DataFrame:
    """(folder, status, added, removed, changed) over rows (folder, id, facets): PASS, DRIFT, ADDED or ORPHANED, with the entries that differ."""
    keyed = lambda df: df.withColumn("_key", F.struct("folder", "id"))
    ops = diff(keyed(old), keyed(new), "_key", facets).select(F.col("id.folder").alias("folder"), F.col("id.id").alias("id"), "op").distinct()
    count = lambda op: F.count_if(F.col("op") == op).alias(op)
    ops = ops.groupBy("folder").agg(count("added"), count("removed"), count("changed"))
    sides = old.groupBy("folder").agg(F.lit(True).alias("_o")).join(new.groupBy("folder").agg(F.lit(True).alias("_n")), "folder", "full_outer").join(ops, "folder", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("added", "removed", "changed")}
    status = F.when(F.col("_o").isNull(), "ADDED").when(F.col("_n").isNull(), "ORPHANED").when(n["added"] + n["removed"] + n["changed"] > 0, "DRIFT").otherwise("PASS")
    return sides.select("folder", status.alias("status"), *[v.alias(k) for k, v in n.items()])


def orphans(old: DataFrame, new: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Paths that the new index does not have any more, but the disk does; all three (path)."""
    return old.join(new, "path", "left_anti").join(on_disk, "path", "left_semi").select("path").distinct()


def affected_roots(members: DataFrame, changed: DataFrame) -> DataFrame:
    """Roots of bundles that hold a changed id."""
    return members.join(changed, "id", "left_semi").select("root").distinct()


def reverse_index(members: DataFrame) -> DataFrame:
    """Per node the number of bundles that hold it and the first."""
    return members.groupBy("id").agg(F.count(F.lit(1)).alias("n_roots"), F.min("root").alias("first_root"))


