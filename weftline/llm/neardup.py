"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct word shingles. Per register the smallest shingle hash of one of REGISTERS buckets is
kept as its leading-zero count and mantissa bits; empty registers borrow from a bucket chosen by register and attempt
(optimal densification), so that two documents agree in a register with probability equal to their Jaccard similarity,
plus rare collisions. Bands of registers give candidate links, a collision-corrected estimate drops those far below the
threshold, and what is left is confirmed on the full shingle sets.

Equal sets are one node from the start. In a band's bucket every node is first compared with one pivot only, the one that
shares buckets with most others, which joins groups of copies by as many comparisons as they have members. Later rounds
look only at buckets whose members are not connected yet: shingles that no open node of another component has make no new
link, so a node with too many of them to reach the threshold leaves (this is exact), and this repeats while nodes leave;
the rest meets a second pivot. What is left at last is decided by rare shingles: two sets share at most the common
shingles that the poorer of them has, and the rare ones that they are seen to share. Pairs meet over a rare shingle, which
few nodes have, or, if common shingles alone could be enough for both, in a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch, broadcast_if_small, components
from weftline.llm.text import chunks, mix, release, utf8, word_hashes

WORDS, PERCENT = 5, 75
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
SIGMAS = 5.0  # by so many standard deviations an estimate must miss the threshold to drop a candidate
SHRINKS = 0.5  # nodes that cannot link are looked for again while fewer than this share of them stays
ROUNDS = 2  # of comparisons with a pivot, before those by rare shingles
RARE = 16  # nodes that have a rare shingle, at most: pairs by rare shingles are at most RARE / 2 for each time one occurs
MAX_IDS = 1 << 21  # ids (about 64 MB) that are broadcast to pick rows by; more are joined by a shuffle

_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_rng = np.random.Generator(np.random.PCG64(20240229))
_DONORS = np.argsort(_rng.random((REGISTERS, REGISTERS)), axis=1).astype(np.int64)  # each register's order of buckets to borrow from


def shingle_sets(data: np.ndarray, at: np.ndarray, i: int, j: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of rows i to j, one row after the other, and where each row begins."""
    w, first, *_ = word_hashes(data, at, i, j)
    n = np.diff(first)
    if len(w) >= words:
        s = sum(w[k : len(w) - words + 1 + k] * _ODD[k] for k in range(words))
    else:
        s = np.zeros(0, np.uint64)
    s = mix(s)
    sets = []
    for a, k in zip(first[:-1], n):
        if k >= words:
            sets.append(np.unique(s[a : a + k - words + 1]))
        elif k:
            sets.append(mix((w[a : a + k] * _ODD[:k]).sum(keepdims=True) + _ODD[59 + k]))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else s), np.concatenate([[0], np.cumsum(sizes)])


def registers(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, uint16 (rows, REGISTERS): leading zeros above MANTISSA mantissa bits. Rows of empty sets are 0."""
    rows = len(begin) - 1
    owner = np.repeat(np.arange(rows), np.diff(begin))
    width = float(1 << 64) / REGISTERS
    scaled = values.astype(np.float64) / width
    bucket = np.minimum(scaled.astype(np.int64), REGISTERS - 1)
    # Hashes are sorted in each row, so a bucket's smallest comes first.
    cell = owner * REGISTERS + bucket
    head = np.ones(len(cell), dtype=bool)
    head[1:] = cell[1:] != cell[:-1]
    low = (values - (bucket * width).astype(np.uint64))[head].astype(np.float64)
    m, e = np.frexp(np.clip(low / width, 2.0**-60, 1 - 2.0**-53))
    packed = ((-e).astype(np.int64) << MANTISSA) + ((m - 0.5) * (2 << MANTISSA)).astype(np.int64)
    out = np.full(rows * REGISTERS, -1, dtype=np.int64)
    out[cell[head]] = packed
    out = out.reshape(rows, REGISTERS)
    r, c = np.nonzero((out < 0) & (np.diff(begin) > 0)[:, None])
    filled = out.copy()
    for attempt in range(REGISTERS):
        if not len(r):
            break
        got = out[r, _DONORS[c, attempt]]
        filled[r, c] = got
        r, c = r[got < 0], c[got < 0]
    return np.maximum(filled, 0).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    return mix((r * _ODD[:ROWS]).sum(2) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


SKETCH = "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, regs binary, bands array<bigint>"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, set size, a 128-bit fingerprint of the set, registers and band keys."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in chunks(at):
                values, begin = shingle_sets(data, at, i, j)
                n = np.diff(begin)
                regs = registers(values, begin)
                full = np.concatenate([values, np.zeros(1, np.uint64)])
                total = [np.where(n > 0, np.add.reduceat(x, np.minimum(begin[:-1], len(values))), 0) for x in (full, np.append(mix(values + _ODD[50]), np.uint64(0)))] if j > i else []
                fp = [mix(t + n.astype(np.uint64)).view(np.int64) for t in total]
                keys = band_keys(regs)
                some = n > 0
                offs = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(fp[0]), pa.array(fp[1]),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[some].ravel())),
                ], names=["doc_id", "n_shingles", "fp1", "fp2", "regs", "bands"])
            release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose corrected estimate does not miss it clearly."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    t = percent / 100

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            n = np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            chance = 1 / 3 / (1 << MANTISSA)
            j = ((ra == rb).mean(1) - chance) / (1 - chance)
            filled = REGISTERS * -np.expm1(-np.maximum(n, 1) / REGISTERS)  # independent registers
            yield batch.select(["a", "b"]).filter(pa.array(j >= t - SIGMAS * np.sqrt(t * (1 - t) / filled)))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(keep, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ok) decided on full shingle sets; each row carries both texts only inside its task."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def decide(batches):
        last, held = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            da, aa = utf8(batch.column("ta"))
            db, ab = utf8(batch.column("tb"))
            for k in range(len(a)):
                sa = shingle_sets(da, aa, k, k + 1)[0]
                this = b[k], db[ab[k] : ab[k + 1]].tobytes()  # an id may have several texts
                if last != this:
                    last, held = this, shingle_sets(db, ab, k, k + 1)[0]
                common = len(np.intersect1d(sa, held, assume_unique=True))
                ok.append(100 * common >= percent * (len(sa) + len(held) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
            release()

    return both.select("a", "b", "ta", "tb").mapInArrow(decide, "a bigint, b bigint, ok boolean")


def _shared_shingles(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) and (node, component) to (node, component, s, n): shingles that another component has too, and how many nodes have them."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in chunks(at):
                values, begin = shingle_sets(data, at, i, j)
                owner = pa.array(np.repeat(np.arange(j - i), np.diff(begin)))
                own = [batch.column(c).slice(i, j - i).take(owner) for c in ("node", "component")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(values.view(np.int64))], names=["node", "component", "s"])

    each = texts.join(broadcast_if_small(nodes, MAX_IDS), "node").select("node", "component", "text").mapInArrow(run, "node bigint, component bigint, s bigint")
    mixed = each.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("s", "n")
    return each.join(mixed, "s")


def _last_pairs(near: DataFrame, size: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components whose shared shingles could be enough; near: key, node, component.

    |x & y| is at most the smaller count of common shingles plus the rare ones that both have. So a pair shares a rare
    shingle, or the smaller count of common ones is enough: the first meet over the shingle, the others in a bucket.
    """
    common = shingles.where(f"n > {RARE}").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    facts = near.select("node").distinct().join(size, "node").join(common, "node", "left").select("node", "size", F.coalesce("common", F.lit(0)).alias("common"))
    rare = shingles.where(f"n <= {RARE}").select("s", "node", "component")
    other = rare.select("s", F.col("node").alias("b"), F.col("component").alias("cb"))
    met = rare.join(other, "s").where("node < b and component <> cb").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("met"))
    side = lambda c: facts.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"), F.col("common").alias(f"c{c}"))
    enough = lambda n: f"(100 + {percent}) * ({n}) >= {percent} * (sa + sb)"
    by_rare = met.join(side("a"), "a").join(side("b"), "b").where(enough("met + least(ca, cb)")).select("a", "b")

    rich = near.select("key", "node", "component").join(facts, "node")
    least = rich.groupBy("key").agg(F.min("size").alias("least"))
    rich = rich.join(least, "key").where(f"(100 + {percent}) * common >= {percent} * (size + least)")
    left = rich.select("key", F.col("node").alias("a"), F.col("component").alias("ka"), F.col("size").alias("sa"), F.col("common").alias("ca"))
    right = rich.select("key", F.col("node").alias("b"), F.col("component").alias("kb"), F.col("size").alias("sb"), F.col("common").alias("cb"))
    by_bucket = left.join(right, (left["key"] == right["key"]) & F.expr("a < b and ka <> kb") & F.expr(enough("least(ca, cb)"))).select("a", "b")
    return by_rare.union(by_bucket)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text. Words split at white space after lower-casing A-Z; with fewer than WORDS words the whole
    sequence is the one shingle. Null or blank texts have no shingle and link with nothing; their component is their own
    id. Rows with a null doc_id take no part: component null, kept. Rows that share a doc_id count as one document that
    has the links of all of them. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = scratch.put(sketches(docs))
    linked = rows.where("doc_id is not null and n_shingles > 0")
    classes = scratch.put(linked.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node")))
    first_of = classes.select(F.col("node").alias("doc_id"), "fp1", "fp2", "n_shingles", "node")
    of_class = lambda some: some.join(first_of, ["doc_id", "fp1", "fp2", "n_shingles"])

    banded = of_class(linked.drop("regs")).select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.put(banded.join(shared, "key").distinct())
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    # Registers and texts of all nodes that share a bucket: picked before they are dealt, and read by every round below.
    ids = scratch.put(members.select("node").distinct())
    picked = lambda some, own: some.join(broadcast_if_small(own, MAX_IDS), "node", "left_semi")
    nodes = of_class(linked.drop("bands").join(broadcast_if_small(ids.withColumnRenamed("node", "doc_id"), MAX_IDS), "doc_id", "left_semi"))
    nodes = scratch.put(nodes.dropDuplicates(["node", "fp1", "fp2"]).select("node", "n_shingles", "regs"))
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text"))
    text = scratch.put(picked(text, ids).distinct())

    def confirm(pairs: DataFrame) -> DataFrame:
        """Decide pairs and return all decided ones."""
        likely = scratch.put(_estimated(pairs, nodes, percent))
        own = scratch.put(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        done = scratch.put(_confirmed(likely, picked(text, own), percent))
        scratch.drop(likely)
        return done

    def still_open(rows: DataFrame) -> DataFrame:
        """Rows (key, node, component, ...) of buckets that hold more than one component."""
        mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return rows.join(mixed, "key")

    def with_pivot(rows: DataFrame, order) -> DataFrame:
        """Rows (key, node, component) with p, the node and component that all others of the bucket are compared with."""
        return scratch.put(rows.join(rows.groupBy("key").agg(F.min_by(F.struct("node", "component"), order).alias("p")), "key").select("key", "node", "component", "p"))

    to_pivot = lambda rows: rows.where("component <> p.component").select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    # A pivot that was compared with all others leaves its bucket: what is open there is open between the others.
    but_pivot = lambda rows: rows.where("node <> p.node").select("key", "node")

    first = with_pivot(members.select("key", "node").join(score, "node").withColumn("component", F.col("node")), F.struct(-F.col("score"), "node"))
    decided, members = confirm(to_pivot(first).distinct()), but_pivot(first)
    links = decided.where("ok").select("a", "b")
    label = components(scratch, links) if links.limit(1).count() else None

    size = nodes.groupBy("node").agg(F.min("n_shingles").alias("size"))

    def may_link(near: DataFrame) -> DataFrame:
        """Rows of open buckets without nodes that share too little with other components to link with any node there."""
        shared = _shared_shingles(text, scratch.put(near.select("node", "component").distinct()))
        most = shared.groupBy("node").agg(F.count(F.lit(1)).alias("most"))
        # 100 |x & y| >= percent |x | y| means (100 + percent) |x & y| >= percent (|x| + |y|). First against the smallest set of
        # all, a row for each node, so that buckets which that closes are left before their members are looked at again.
        facts = scratch.put(most.join(size, "node").join(near.select("node").distinct(), "node", "left_semi"))
        smallest = facts.agg(F.min("size")).first()[0]
        may = facts.where(f"(100 + {percent}) * most >= {percent} * (size + {int(smallest or 0)})")
        near = near.select("key", "node", "component").join(broadcast_if_small(may, MAX_IDS), "node")
        mixed = near.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("size").alias("least")).where("lo < hi").select("key", "least")
        # Written before its buckets are looked at again, which reads it twice.
        near = scratch.put(near.join(mixed, "key").where(f"(100 + {percent}) * most >= {percent} * (size + least)").select("key", "node", "component"))
        return scratch.put(still_open(near))

    for turn in range(ROUNDS):
        joined = members.withColumn("component", F.col("node")) if label is None else members.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        near = scratch.put(still_open(joined))
        left = near.select("node").distinct().count()
        while left:  # whoever leaves takes shingles along that others then share with fewer
            before, near = left, may_link(near)
            left = near.select("node").distinct().count()
            if left > SHRINKS * before:
                break
        if not left:
            break
        if turn < ROUNDS - 1:
            near = with_pivot(near, F.xxhash64(F.lit(turn), "node"))
            pairs, members = to_pivot(near), but_pivot(near)
        else:
            pairs = _last_pairs(near, size, scratch.put(_shared_shingles(text, scratch.put(near.select("node", "component").distinct()))), percent)
        tried = decided.select("a", "b").union(decided.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = confirm(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        decided, new = decided.union(found), found.where("ok").select("a", "b")
        if new.limit(1).count():
            links = links.union(new)
            label = components(scratch, links)

    if label is None:
        label = spark.createDataFrame([], "id bigint, component bigint")
    class_of = classes.join(label.withColumnRenamed("id", "node"), "node", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "fp1", "fp2").join(class_of, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
