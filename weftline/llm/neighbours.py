"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations turn unit vectors, and a vector's cell is the signed axis it is nearest to. Every row is
indexed in every table; a query probes the cells with the largest coordinates of its own rotation, and everything found
there is scored exactly. Cells know directions only, while inner products also grow with a row's length, and a long row
may be a neighbour at any angle. So a second step scores exactly every row so long that it could beat a query's k-th score
at an angle too wide for the probes to be sure: cells are left to find only rows at cosines that they find surely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch
from weftline.llm.vectors import matrix, packed

K = 20
TABLES = 4
PROBED = 0.25  # of the cells, in each table
BLOCK = 2048  # rows of a cell scored together
SURE = 0.95  # share of rows at a cosine that probes must find, or all rows that need this cosine are scored
BAND = 1.1  # lengths within a band differ by this factor
BANDS = 256  # the last holds all shorter rows too


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row size is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotate(unit: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, padded to a power of two."""
    size = 1 << max(1, math.ceil(math.log2(unit.shape[1])))
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    rng = np.random.Generator(np.random.PCG64([41, table, size]))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size))
    return x


def probes(turned: np.ndarray, count: int) -> np.ndarray:
    """The count best cells of each row, nearest axis first; cell 2i is axis i, cell 2i + 1 its opposite."""
    both = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def sure_cosine(dim: int, tables: int, count: int, sample: int = 4096) -> float:
    """Least cosine from which the probes find SURE of the rows, measured on random pairs; infinite if there is none."""
    rng = np.random.Generator(np.random.PCG64([43, dim]))
    a, b = rng.standard_normal((2, sample, dim))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.sqrt((b * b).sum(1, keepdims=True)), 1e-300)
    turned = [(rotate(a, t), rotate(b, t)) for t in range(tables)]
    least = math.inf
    for step in range(99, -1, -1):
        cos, hit = step / 100, np.zeros(sample, dtype=bool)
        for x, y in turned:
            y = cos * x + math.sqrt(1 - cos * cos) * y
            axis = np.abs(y).argmax(1)[:, None]
            side = (np.take_along_axis(x, axis, 1) * np.sign(np.take_along_axis(y, axis, 1)))
            hit |= (x > side).sum(1) + (-x > side).sum(1) < count
        if hit.mean() < SURE:
            break
        least = cos
    return least


def lengths(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(1, keepdims=True)
    return top[:, 0] * np.sqrt(((v / top) ** 2).sum(1))


def band(length: np.ndarray, longest: float) -> np.ndarray:
    """Band of each length, 0 for the longest rows."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log(longest / length) / math.log(BAND) + 1e-9), 0, BANDS - 1).astype(np.int64)


def _cells(vectors: DataFrame, tables: int, count: int) -> DataFrame:
    """vectors (vec_id, vec) with one row per table and probed cell."""

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("vec"))
            if not len(v):
                continue
            v = v / np.abs(v).max(1, keepdims=True)
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
            for t in range(tables):
                cells = probes(rotate(v, t), count)
                rows = pa.array(np.repeat(np.arange(len(v)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("vec").take(rows), pa.array(cells.ravel() * tables + t)], names=["vec_id", "vec", "cell"])

    return vectors.mapInArrow(run, "vec_id bigint, vec binary, cell bigint")


def _in_band(vectors: DataFrame, longest: float) -> DataFrame:
    """vectors (vec_id, vec) with the band of their length as cell."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(band(lengths(matrix(batch.column("vec"))), longest))], names=["vec_id", "vec", "cell"])

    return vectors.mapInArrow(run, "vec_id bigint, vec binary, cell bigint")


def _unsure(queries: DataFrame, longest: float, cosine: float) -> DataFrame:
    """queries (vec_id, vec, kth: k-th score so far, or null) to (vec_id, vec, last): bands up to last hold rows that reach
    the k-th score below the cosine; queries without such rows are left out."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kth = batch.column("kth").to_numpy(zero_copy_only=False)  # null becomes nan
            least = np.where(kth > 0, kth / lengths(matrix(batch.column("vec"))) / cosine, 0.0)
            rows = np.flatnonzero(least <= longest * (1 + 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), batch.column("vec").take(pa.array(rows)), pa.array(band(least[rows], longest))], names=["vec_id", "vec", "last"])

    return queries.mapInArrow(run, "vec_id bigint, vec binary, last bigint")


def _score(rows: DataFrame, k: int) -> DataFrame:
    """rows: cell, block, query (boolean), vec_id, vec, sorted by block and data before queries; best k per query and block."""

    def run(batches):
        now, data, held = None, None, []
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "block", "query")])
            cuts = [0, *(np.flatnonzero((np.diff(where) != 0).any(0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if now != (place := (int(where[0, a]), int(where[1, a]))):
                    now, data, held = place, None, []
                if not where[2, a]:
                    held.append(part)
                    continue
                if data is None:
                    if not held:
                        continue
                    whole = pa.Table.from_batches(held).combine_chunks()
                    data = whole.column("vec_id").to_numpy(), matrix(whole.column("vec").combine_chunks())
                    held = []
                ids, x = data
                for start in range(0, part.num_rows, 512):
                    some = part.slice(start, 512)
                    q, qid = matrix(some.column("vec")), some.column("vec_id").to_numpy()
                    s = q @ x.T
                    s[qid[:, None] == ids[None, :]] = -np.inf
                    m = min(k, len(ids))
                    level = np.partition(s, len(ids) - m, axis=1)[:, len(ids) - m]
                    i, j = np.nonzero((s >= (level - 1e-9 * np.maximum(np.abs(level), 1))[:, None]) & (s > -np.inf))
                    exact = (q[i] * x[j]).sum(1)
                    order = np.lexsort((ids[j], -exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    first = np.searchsorted(i, np.arange(len(qid)))
                    keep = np.arange(len(i)) - first[i] < k
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i[keep]]), pa.array(ids[j[keep]]), pa.array(exact[keep])], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(data: DataFrame, asked: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Best k per query and block, where data and asked (vec_id, vec, cell) share a cell; sizes: cell and its blocks."""
    data = data.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("query", F.lit(False))
    asked = asked.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    columns = ["cell", "block", "query", "vec_id", "vec"]
    rows = data.select(columns).union(asked.select(columns))
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _score(rows.repartition(4 * parts, "cell", "block").sortWithinPartitions("cell", "block", "query", "vec_id"), k)


def _sizes(scratch: Scratch, data: DataFrame) -> DataFrame:
    sizes = data.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return F.broadcast(scratch.put(sizes))  # at most one row per cell and table (4 x dimension x tables) or band


def nearest(embeddings: DataFrame, is_query, k: int = K, tables: int = TABLES, probed: float = PROBED, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets is_query its k rows of largest inner product, not itself.

    Scores are exact inner products in double precision. Queries whose probes hold fewer than k rows are scored against all
    rows, so that fewer than k come back only if there are no more. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, neither do null ids and vectors of another size than most. Rows with a query's id are it.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "nearest")
    vectors = packed(embeddings, id_col, column)
    dim = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dim:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = dim[0]["dim"]
    vectors = scratch.put(vectors.where(F.col("dim") == dim))
    norm = F.sqrt(F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    from weftline.llm.vectors import usable

    high, n = usable(embeddings, column).where(F.size(column) == dim).agg(F.max(norm), F.count_distinct(id_col)).first()
    queries = vectors.where(is_query).select("vec_id", "vec")
    cells = 2 << max(1, math.ceil(math.log2(dim)))
    count = max(1, round(cells * probed))
    data = _cells(vectors.select("vec_id", "vec"), tables, 1)
    found = scratch.put(_best(_search(data, _cells(queries, tables, count), _sizes(scratch, data), k), k))
    kth = found.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    unsure = scratch.put(_unsure(queries.join(kth, "vec_id", "left"), high, sure_cosine(dim, tables, count)))
    if n > 1 and unsure.limit(1).count():
        data = _in_band(vectors.select("vec_id", "vec"), high)
        asked = unsure.select("vec_id", "vec", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("cell"))
        found = _best(found.select("query_id", "vec_id", "score").union(_search(data, asked, _sizes(scratch, data), k)), k)
    return found


def op2(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
