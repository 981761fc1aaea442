"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated at random once and stored as its signs, one correction factor (its inner product with its own
code) and its rotated coordinates in a byte each. From one vector's code and factor and the other's bytes follows an
unbiased estimate of the pair's cosine with a confidence bound; only for pairs whose upper bound reaches the threshold are
the vectors fetched and the cosine recomputed exactly, and only exact cosines make links.

Pairs to look at come from tables that hash sampled code bits. Within a tight group nothing is paired: vectors within
half the threshold angle of one pivot are all linked with each other by the triangle inequality, so such a core counts
by its size. What is left is compared inside the tables' buckets in blocks, first by codes; rows with an undecided pair
meet once more with their vectors, where a pair counts in the first table it shares only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch, components
from weftline.llm.text import mix
from weftline.llm.vectors import matrix, packed

COSINE = 0.9
RECALL = 0.95  # of pairs exactly at the threshold; pairs above it are found more surely
EXTRA_BITS = 2
EPS = 4.0  # confidence bounds are this many standard errors wide
BLOCK = 1024  # rows of a bucket that are compared with each other or with another block at once
SMALL = 64  # rows of a bucket whose pairs are listed together with those of other small buckets
ROWS = 8192  # rows of whole buckets taken up at once
PAIRS = 1 << 16  # listed pairs whose numbers are held at once


class Codes:
    """Rotations and tables for vectors of one dimension and a table of about n vectors."""

    def __init__(self, dim: int, n: int, cosine: float = COSINE):
        rng = np.random.Generator(np.random.PCG64([71, dim]))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].T
        self.dim = dim
        self.bits = max(8, math.ceil(math.log2(max(n, 2))) + EXTRA_BITS)
        agree = (1 - math.acos(cosine) / math.pi) ** self.bits
        self.tables = max(8, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))
        # Every table has directions of its own, all drawn independently, as the number of tables assumes.
        self.directions = rng.standard_normal((self.tables, self.bits, dim))
        self.weight = mix(rng.integers(1, 1 << 62, self.bits).astype(np.uint64)) | np.uint64(1)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Bucket of each vector (rows) in each table, as int64; the table is part of the hash."""
        salt = mix(np.arange(1, self.tables + 1, dtype=np.uint64) + (np.uint64(self.dim) << np.uint64(32)))
        out = np.empty((len(unit), self.tables), dtype=np.int64)
        for t in range(self.tables):
            sign = (unit @ self.directions[t].T > 0).astype(np.uint64)
            h = (sign * self.weight).sum(1) + salt[t]
            out[:, t] = mix(h).view(np.int64)
        return out

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs of the rotated vectors, correction factors, and the rotated vectors as bytes with their scales."""
        turned = unit @ self.rotation.T
        factor = np.maximum(np.abs(turned).sum(1) / math.sqrt(self.dim), 1e-9)
        scale = np.maximum(np.abs(turned).max(1), 1e-300) / 127
        return np.packbits(turned >= 0, axis=1), factor, np.rint(turned / scale[:, None]).astype(np.int8), scale

    def slack(self, factor: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """How far the true cosine may lie above the estimate: EPS standard errors, and all that the bytes may be off."""
        return EPS * np.sqrt(np.maximum(1 - factor**2, 0.0)) / factor / math.sqrt(max(self.dim - 1, 1)) + scale / 2 * math.sqrt(self.dim) / factor


class Compact:
    """The stored codes of an Arrow table's rows, of one dimension, with a suffix to its column names."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, c: Codes, coded: str = "", byted: str = ""):
        flat = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=kind).reshape(rows.num_rows, -1)
        self.c = c
        self.signs = np.where(np.unpackbits(flat("code" + coded, np.uint8), axis=1)[:, : c.dim] > 0, np.float32(1), np.float32(-1))
        self.factor = rows.column("factor" + coded).to_numpy()
        self.bytes = flat("bytes" + byted, np.int8).astype(np.float32)
        self.scale = rows.column("scale" + byted).to_numpy()

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds for listed pairs: bytes of rows i, codes of rows j."""
        dots = np.einsum("ij,ij->i", self.bytes[i], self.signs[j]).astype(np.float64)
        return dots * self.scale[i] / math.sqrt(self.c.dim) / self.factor[j] + self.c.slack(self.factor[j], self.scale[i])

    def upper_all(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dots = (self.bytes[i] @ self.signs[j].T).astype(np.float64) * self.scale[i][:, None]
        return dots / math.sqrt(self.c.dim) / self.factor[j] + self.c.slack(self.factor[j][None, :], self.scale[i][:, None])


_CODES: dict = {}


def codes(dim: int, n: int) -> Codes:
    if (dim, n) not in _CODES:
        _CODES[dim, n] = Codes(dim, n)
    return _CODES[dim, n]


def unit_rows(vecs: np.ndarray) -> np.ndarray:
    scaled = vecs / np.abs(vecs).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _by_dim(batch: pa.RecordBatch):
    dim = batch.column("dim").to_numpy()
    for d in np.unique(dim):
        yield int(d), np.flatnonzero(dim == d)


CODED = "code binary, factor double, bytes binary, scale double"


def _sketch(vectors: DataFrame, n: int) -> DataFrame:
    """vectors (vec_id, dim, vec) plus fingerprint, buckets and codes."""

    def run(batches):
        for batch in batches:
            for d, rows in _by_dim(batch):
                part = batch.take(pa.array(rows))
                v = matrix(part.column("vec")) + 0.0  # -0.0 becomes 0.0
                h = mix(v.view(np.uint64) + mix(np.arange(1, d + 1, dtype=np.uint64)))
                c, unit = codes(d, n), unit_rows(v)
                keys = c.keys(unit)
                code, factor, turned, scale = c.code(unit)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("dim"), part.column("vec"), pa.array(h.sum(1).view(np.int64)), pa.array(mix(h).sum(1).view(np.int64)), bands, binary(code), pa.array(factor), binary(turned), pa.array(scale)],
                    names=["vec_id", "dim", "vec", "fp1", "fp2", "bands", "code", "factor", "bytes", "scale"],
                )

    return vectors.mapInArrow(run, f"vec_id bigint, dim int, vec binary, fp1 bigint, fp2 bigint, bands array<bigint>, {CODED}")


def pair_cosines(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, floor: float, n: int) -> DataFrame:
    """Of the pairs (a, b), those with exact cosine >= floor, with it; codes leave out what is surely below."""
    left = nodes.select(F.col("node").alias("a"), "dim", F.col("bytes").alias("bytes_a"), F.col("scale").alias("scale_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("dim").alias("dim_b"), F.col("code").alias("code_b"), F.col("factor").alias("factor_b"))

    def near(batches):
        for batch in batches:
            for d, rows in _by_dim(batch):
                part = batch.take(pa.array(rows))
                both, every = Compact(part, codes(d, n), "_b", "_a"), np.arange(len(rows))
                yield part.select(["a", "b"]).filter(pa.array(both.upper(every, every) >= floor))

    def exact(batches):
        for batch in batches:
            for _, rows in _by_dim(batch):
                part = batch.take(pa.array(rows))
                cos = (unit_rows(matrix(part.column("va"))) * unit_rows(matrix(part.column("vb")))).sum(1)
                keep = np.flatnonzero(cos >= floor)
                yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(keep)), part.column("b").take(pa.array(keep)), pa.array(cos[keep])], names=["a", "b", "cos"])

    both = pairs.join(left, "a").join(right, "b").where("dim = dim_b").select("a", "b", "dim", "bytes_a", "scale_a", "code_b", "factor_b")
    both = scratch.put(both.mapInArrow(near, "a bigint, b bigint"))
    vecs = lambda s: nodes.select(F.col("node").alias(s), F.col("vec").alias(f"v{s}"), *(["dim"] if s == "a" else []))
    return both.join(vecs("a"), "a").join(vecs("b"), "b").select("a", "b", "va", "vb", "dim").mapInArrow(exact, "a bigint, b bigint, cos double")


def _buckets(batches):
    """Tables of whole buckets (rows of equal key, part) of one dimension, of ROWS rows or one bucket, and where each begins."""
    held: list[pa.RecordBatch] = []
    last, n = None, 0

    def done():
        whole = pa.Table.from_batches(held).combine_chunks()
        where = np.stack([whole.column("key").to_numpy(), whole.column("part").to_numpy().astype(np.int64)])
        held.clear()
        return whole, np.concatenate([[0], np.flatnonzero((np.diff(where) != 0).any(0)) + 1, [whole.num_rows]])

    for batch in batches:
        where = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "part", "dim")])
        cuts = [0, *(np.flatnonzero((np.diff(where) != 0).any(0)) + 1).tolist(), batch.num_rows]
        begun = 0
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            now = tuple(where[:, a].tolist())
            if last is not None and now != last and (n + a - begun >= ROWS or now[2] != last[2]):
                if a > begun:
                    held.append(batch.slice(begun, a - begun))
                if held:
                    yield done()
                begun, n = a, 0
            last = now
        if begun < batch.num_rows:
            held.append(batch.slice(begun))
            n += batch.num_rows - begun
    if held:
        yield done()


def _listed(begins: np.ndarray, side: np.ndarray):
    """Pairs of rows to compare: listed (i, j) of small buckets, PAIRS or so at once, and (rows, rows, None) of each large one."""
    size = np.diff(begins)
    small = size <= SMALL
    row = np.flatnonzero(np.repeat(small, size))
    end = np.repeat(begins[1:], size)[row]
    ahead = end - row - 1
    for part in np.array_split(np.arange(len(row)), max(1, int(ahead.sum()) // PAIRS)):
        n = ahead[part]
        i = np.repeat(row[part], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        meet = (side[i] == 0) | (side[i] != side[j])
        yield i[meet], j[meet], True
    for a, b in zip(begins[:-1][~small], begins[1:][~small]):
        rows = np.arange(a, b)
        two = side[rows] == 2
        yield rows[~two], rows[two] if two.any() else rows, False


def undecided(members: DataFrame, n: int, cosine: float) -> DataFrame:
    """(key, part, side, node) of the rows that codes let have a link with another core in their bucket.

    members: key, part (block pair), side, node, core, dim and codes, sorted by key and part.
    """

    def run(batches):
        for whole, begins in _buckets(batches):
            rows = Compact(whole, codes(whole.column("dim")[0].as_py(), n))
            core, side = whole.column("core").to_numpy(), whole.column("side").to_numpy()
            hit = np.zeros(whole.num_rows, dtype=bool)
            for i, j, listed in _listed(begins, side):
                if listed:
                    apart = core[i] != core[j]
                    i, j = i[apart], j[apart]
                    near = rows.upper(i, j) >= cosine
                    hit[i[near]] = hit[j[near]] = True
                else:
                    near = (rows.upper_all(i, j) >= cosine) & (core[i][:, None] != core[j][None, :])
                    hit[i[near.any(1)]] = hit[j[near.any(0)]] = True
            yield from whole.select(["key", "part", "side", "node"]).filter(pa.array(hit)).to_batches()

    return members.mapInArrow(run, "key bigint, part bigint, side int, node bigint")


def cross_links(members: DataFrame, cosine: float) -> DataFrame:
    """Links between different cores. members: key, part, side, node, core, w, dim, vec, bands, sorted by key and part; one
    row (a, b, n) per node with links (a = node, b null, n = linked weight) and per connecting pair (a, b, n = 0)."""

    def run(batches):
        for whole, begins in _buckets(batches):
            unit = unit_rows(matrix(whole.column("vec").combine_chunks()))
            ids, core, weight, side, key = (whole.column(x).to_numpy() for x in ("node", "core", "w", "side", "key"))
            bands = whole.column("bands").combine_chunks().flatten().to_numpy().reshape(whole.num_rows, -1)
            lefts, rights = [], []
            for i, j, listed in _listed(begins, side):
                if not listed:
                    near = unit[i] @ unit[j].T >= cosine - 1e-9
                    if i is j or np.array_equal(i, j):
                        near &= np.tri(len(i), k=-1, dtype=bool).T
                    x, y = np.nonzero(near)
                    i, j = i[x], j[y]
                for at in range(0, len(i), PAIRS):
                    x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                    keep = core[x] != core[y]
                    x, y = x[keep], y[keep]
                    keep = (unit[x] * unit[y]).sum(1) >= cosine
                    x, y = x[keep], y[keep]
                    first = (bands[x] == bands[y]).argmax(1)
                    keep = bands[x, first] == key[x]
                    lefts.append(x[keep])
                    rights.append(y[keep])
            i, j = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (lefts, rights))
            gained = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
            label = np.arange(len(ids))
            while len(i):  # smallest label over links until nothing changes: as many links as rows are enough to connect them
                low = np.minimum(label[i], label[j])
                new = label.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                if (new == label).all():
                    break
                label = new
            some, far = np.flatnonzero(gained), np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids[some], ids[far]])), pa.array([None] * len(some) + ids[label[far]].tolist(), pa.int64()),
                pa.array(np.concatenate([gained[some], np.zeros(len(far))]).astype(np.int64)),
            ], names=["a", "b", "n"])

    return members.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicate_vectors(embeddings: DataFrame, id_col: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Links are pairs found with cosine >= the threshold, in double precision on the original vectors. Equal vectors are one
    node with a weight. Vectors that are null, empty, zero or hold null or non-finite components, and vectors of another
    size, link with nothing: n_links 0, component their own id. A null id takes no part: component null, kept. Rows that
    repeat an id with equal vectors count as vectors of their own. Other columns, whatever their names, are left out. An
    empty table gives no rows.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vecdedup")
    n = 1 << math.ceil(math.log2(max(embeddings.count(), 2)))
    vectors = scratch.put(_sketch(packed(embeddings, id_col, column), n))
    classes = scratch.put(vectors.groupBy("fp1", "fp2", "dim").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("w")))
    nodes = vectors.join(classes.withColumn("vec_id", F.col("node")), ["vec_id", "fp1", "fp2", "dim"]).dropDuplicates(["node", "fp1", "fp2"])
    nodes = scratch.put(nodes.select("node", "dim", "vec", "w", "bands", "code", "factor", "bytes", "scale"))

    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = scratch.put(banded.join(shared, "key").select("key", "node", "pivot"))

    # Cores: of the pivots within half the angle, the one with the most such vectors.
    half = math.cos(math.acos(cosine) / 2 - 1e-7)
    near = pair_cosines(scratch, members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), nodes, half, n)
    near = scratch.put(near.select(F.col("a").alias("node"), F.col("b").alias("core")))
    crowd = near.groupBy("core").agg(F.count(F.lit(1)).alias("size"))
    best = near.join(crowd, "core").groupBy("node").agg(F.min_by("core", F.struct(-F.col("size"), "core")).alias("core"), F.max("size").alias("size"))
    # A pivot with followers stays in its own core unless a more followed one is near.
    own = crowd.select(F.col("core").alias("node"), F.col("size").alias("own"))
    core = nodes.select("node", "w").join(best, "node", "left").join(own, "node", "left")
    stays = F.col("core").isNull() | (F.coalesce("own", F.lit(0)) > F.col("size")) | ((F.coalesce("own", F.lit(0)) == F.col("size")) & (F.col("node") < F.col("core")))
    core = scratch.put(core.select("node", "w", F.when(stays, F.col("node")).otherwise(F.col("core")).alias("core")))

    placed = members.select("key", "node").join(core, "node")
    mixed = placed.groupBy("key").agg(F.min("core").alias("lo"), F.max("core").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # Block x of B meets blocks 0 to B - 1: pair (lo, hi) is part lo * B + hi.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    placed = placed.withColumn("part", lo * F.col("blocks") + hi).withColumn("side", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2))
    placed = placed.withColumn("part", F.col("part").cast("bigint")).select("key", "part", "side", "node", "core")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(parts, "key", "part").sortWithinPartitions("dim", "key", "part", "side", "node")
    coded = placed.join(nodes.select("node", "dim", "code", "factor", "bytes", "scale"), "node")
    unsure = scratch.put(undecided(dealt(coded), n, cosine))
    whole = unsure.join(core, "node").join(nodes.select("node", "dim", "vec", "bands"), "node")
    found = scratch.put(cross_links(dealt(whole), cosine))

    edges = found.where("b is not null").select("a", "b").union(core.where("node <> core").select(F.col("node").alias("a"), F.col("core").alias("b")))
    label = components(scratch, edges).withColumnRenamed("id", "node")
    size = core.groupBy("core").agg(F.sum("w").alias("crowd"))
    more = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    per_node = core.join(size, "core").join(more, "node", "left").join(label, "node", "left")
    per_node = per_node.select("node", (F.col("crowd") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    per_class = classes.join(per_node, "node").select("fp1", "fp2", "dim", "n_links", "component_id")
    linked = vectors.select("vec_id", "fp1", "fp2", "dim").join(per_class, ["fp1", "fp2", "dim"]).select("vec_id", "n_links", "component_id")

    ids = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(column))
    good = packed_ids(ids, column)
    rest = good.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def packed_ids(df: DataFrame, column: str) -> DataFrame:
    """vec_id and whether the row takes part; the same test as vectors.usable."""
    v = F.col(column)
    fine = F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    return df.select("vec_id", (F.col("vec_id").isNotNull() & fine & F.coalesce(F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))).alias("good"))


def op7(spark, sf_dir: str) -> DataFrame:
    """The registered query: links and components of all embeddings."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
