"""Incremental rebuild: a store of contracts, uses, roots and bundles that follows batches of changed files.

A batch extracts its own files only. What follows from them is found by joins with the keys that changed: uses whose name
could now resolve otherwise, files that may have become or ceased to be roots, bundles that hold a changed file. Only these
are searched again. After any batches the tables equal those of a whole run over the files that are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import engine
from weftline.functions.paths import CODE, base_name, code_stem, normalize, parent
from weftline.operators import contract as C
from weftline.operators import graph
from weftline.operators.scan import file_hash
from weftline.storage import Scratch
from weftline.streaming.store import Store

KEYS = {"contracts": "id", "uses": "src", "roots": "id", "members": "root", "missing": "root", "hashes": "root", "violations": "epoch", "counts": "epoch"}
TASK_FILES = 1000  # changed files whose contracts a task extracts


def _keys_of_file(path: Column) -> Column:
    """What a name must look like to resolve to this file: its base name (siblings compare without case), its folder's if it is
    an index, the whole path."""
    low, own = F.lower(normalize(path)), code_stem(path)
    of_index = F.when(own == "index", base_name(F.regexp_replace(parent(path), "/$", "")))
    return F.array_distinct(F.array_compact(F.array(own, F.lower(own), F.lower(of_index), low)))


def _keys_of_name(name: Column) -> Column:
    return F.array_distinct(F.array(F.regexp_replace(name, CODE, ""), name, F.lower(name), F.lower(normalize(name))))


class Incremental:
    """The tables of a run that are kept up to date at path.

    apply() takes changes(path, text, ts): a null text says that the file is gone; the newest row of a path counts, and one
    whose hash is known changes nothing. A batch that runs again after a failure, or one that was committed, leaves the same
    tables. With strict, the batch's violations and running counts are kept too.
    """

    def __init__(self, spark: SparkSession, path: str, options: engine.Options = engine.Options(), strict: bool = False, include_style: bool = False):
        self.spark, self.options, self.strict = spark, options, strict
        self.store = Store(spark, path, KEYS)

    def table(self, name: str) -> DataFrame | None:
        return self.store.read(name)

    def context(self) -> engine.Context:
        """The same tables as engine.context_of() gives."""
        state = self.store.state()
        read = lambda name: self.store.read(name, state)
        members = read("members")
        return engine.Context(read("contracts"), members, graph.bundle_edges(members, engine.edges_of(read("uses"))), read("missing"), read("hashes"))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        state = self.store.state()
        if state["epoch"] is not None and state["epoch"] >= epoch:
            return
        scratch = Scratch(self.spark, "incremental")
        old = {name: self.store.read(name, state) for name in KEYS}
        last = batch.groupBy("path").agg(F.max_by(F.struct("text"), F.struct("ts", F.col("text").isNotNull(), "text")).alias("r")).select("path", "r.text")
        last = last.withColumn("file_hash", file_hash(F.col("text")))
        first = old["contracts"] is None
        if not first:
            known = old["contracts"].select(F.col("id").alias("path"), F.col("file_hash").alias("_known"))
            last = last.join(known, "path", "left").where("not (file_hash <=> _known)").drop("_known")
        else:
            last = last.where("text is not null")
        changed = scratch.put(last)
        n = changed.count()
        if not first and not n:
            return self.store.commit(epoch, {})
        # Dealt by number: texts of one shape take few bytes, and Spark would read them in one task.
        sources_of = changed.where("text is not null").select("path", "text").repartition(max(1, -(-n // TASK_FILES)), "path")
        fresh = scratch.put(engine.contracts_of(sources_of, self.options.include_style))
        ids = scratch.put(changed.select(F.col("path").alias("id")))
        contracts = fresh if first else self._replace(old["contracts"], ids, "id", fresh)
        files = contracts.select(F.col("id").alias("path"))

        # Uses of changed files, and of others whose name meets a file that came or went.
        if first:
            uses = touched_uses = scratch.put(graph.resolve_dependency(engine.names_used(fresh), files))
            sources = ids
        else:
            here = old["contracts"].select("id")
            moved = ids.join(here, "id", "left_anti").union(changed.where("text is null").select("path"))
            keys = moved.select(F.explode(_keys_of_file(F.col("id"))).alias("key")).distinct()
            others = old["uses"].join(ids.select(F.col("id").alias("src")), "src", "left_anti").select("src", "name")
            again = others.withColumn("key", F.explode(_keys_of_name(F.col("name")))).join(keys, "key", "left_semi").select("src").distinct()
            sources = scratch.put(ids.union(again.select(F.col("src").alias("id"))).distinct())
            names = engine.names_used(contracts.join(sources, "id", "left_semi"))
            touched_uses = scratch.put(graph.resolve_dependency(names, files))
            uses = self._replace(old["uses"], sources.select(F.col("id").alias("src")), "src", touched_uses)
        edges = engine.edges_of(uses)

        # Files that may have become or ceased to be roots: those that came or went, and ends of edges that did.
        if first:
            candidates = ids
            members_of = None
        else:
            before = engine.edges_of(old["uses"].join(sources.select(F.col("id").alias("src")), "src", "left_semi"))
            after = engine.edges_of(touched_uses)
            turned = before.exceptAll(after).union(after.exceptAll(before))
            candidates = ids.union(turned.select(F.col("dst").alias("id"))).distinct()
            members_of = old["members"].join(sources.union(turned.select(F.col("src").alias("id"))).distinct(), "id", "left_semi").select(F.col("root").alias("id")).distinct()
        candidates = scratch.put(candidates)
        now_roots = scratch.put(candidates.join(files.select(F.col("path").alias("id")), "id", "left_semi").join(edges.select(F.col("dst").alias("id")), "id", "left_anti"))
        roots = now_roots if first else self._replace(old["roots"], candidates, "id", now_roots)

        # Bundles to search again: new roots and those that hold what changed, as long as they are roots; lost roots go.
        due = candidates if first else candidates.union(members_of).distinct()
        due = scratch.put(due)
        search = scratch.put(due.join(roots, "id", "left_semi"))
        members = scratch.put(graph.reach(search, edges, self.options.depth, self.options.max_nodes))
        missing = engine.missing_of(members, uses, contracts, self.options.depth)
        hashes = graph.bundle_hash(members.join(contracts.select("id", "semantic_hash"), "id"), self.options.depth)
        root_keys = due.select(F.col("id").alias("root"))
        changes = {
            "contracts": (ids, fresh), "uses": (sources.select(F.col("id").alias("src")), touched_uses), "roots": (candidates, now_roots),
            "members": (root_keys, members), "missing": (root_keys, missing), "hashes": (root_keys, hashes),
        }
        if self.strict:
            changes |= self._strict(epoch, old, ids, fresh, scratch.put(missing), state)
        self.store.commit(epoch, changes)

    def _replace(self, table: DataFrame, keys: DataFrame, key: str, rows: DataFrame) -> DataFrame:
        return table.join(keys, key, "left_anti").select(table.columns).unionByName(rows)

    def _strict(self, epoch: int, old: dict, ids: DataFrame, fresh: DataFrame, missing: DataFrame, state: dict) -> dict:
        """What the batch broke: (epoch, type, severity, id, name), and its counts with those of all batches so far."""
        one = self.spark.range(1)  # rows of constants, made without a Python worker
        empty = one.where("false").selectExpr("id AS epoch", *(f"CAST(NULL AS STRING) AS {c}" for c in ("type", "severity", "id", "name")))
        if old["contracts"] is None:
            found = empty
        else:
            before = old["contracts"].join(ids, "id", "left_semi")
            seen = C.changes(before, fresh)
            known = old["missing"].select("name").distinct()
            lost = missing.select("name").distinct().join(known, "name", "left_anti")
            found = C.violations(seen, C.contract_diff(before, fresh), lost).withColumn("epoch", F.lit(epoch).cast("bigint")).select(empty.columns)
        found = Scratch(self.spark, "violations").put(found)
        so_far = old["counts"].agg(F.max_by(F.struct("errors_so_far", "warnings_so_far"), "epoch").alias("r")).select("r.*").first() if old["counts"] is not None else None
        errors, warnings = found.agg(F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")).first()
        row = {"epoch": epoch, "errors": errors, "warnings": warnings, "errors_so_far": errors + (so_far[0] if so_far else 0), "warnings_so_far": warnings + (so_far[1] if so_far else 0)}
        counts = one.select(*[F.lit(v).cast("bigint").alias(c) for c, v in row.items()])
        key = counts.select("epoch")
        return {"violations": (key, found), "counts": (key, counts)}


class StrictError(RuntimeError):
    """A strict watch has met errors; the batch that holds them is committed."""


def follow(changes: DataFrame, incremental: Incremental, checkpoint: str, then: Callable[[int], None] | None = None, once: bool = False, stop_on_error: bool = False):
    """Start a stream of changes(path, text, ts) into the tables; then(epoch) runs after each commit.

    The stream goes on from its checkpoint after a restart. With stop_on_error a strict watch ends at its first error.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        incremental.apply(batch, epoch)
        if then is not None:
            then(epoch)
        if stop_on_error and incremental.strict and incremental.table("violations").where((F.col("epoch") == epoch) & (F.col("severity") == "error")).limit(1).count():
            raise StrictError(f"batch {epoch} breaks a contract")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
