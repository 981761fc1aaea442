"""Hard-negative mining by angular triangle filtering.

Every row keeps its angles to a few reference directions. For an anchor and a row, angles a and x to one reference bound the
angle between them by |a - x| and a + x (and 2 pi less that); with the norms these give bounds of the integer score, rounded
outwards. A row gets its integer score only where its bounds overlap what is still asked for. Anchors and rows meet in
blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch, broadcast_if_small

REFERENCES = 8
SAMPLE = 2048  # rows, those with the smallest hashes of their ids, from which the references are chosen
ANCHOR_BLOCK, ROW_BLOCK = 512, 8192  # rows of a block; fewer where vectors are long
BLOCK_VALUES = 1 << 20
SLACK = 1e-9  # radians and parts of a score that bounds are widened by; computed angles are right to 1e-15
ROW = "vec_id bigint, label int, dim int, q binary, norm double, angles binary"


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles."""
    return np.floor(256.0 * values)


def unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(-1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def angles_to(rows: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of unit rows to unit references, by the lengths of difference and sum: right near 0 and pi too."""
    out = np.empty((len(rows), len(refs)))
    for k, r in enumerate(refs):
        out[:, k] = 2 * np.arctan2(np.sqrt(((rows - r) ** 2).sum(1)), np.sqrt(((rows + r) ** 2).sum(1)))
    return out


def choose_references(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """By dimension, unit directions of sampled vectors that lie far from each other: each the farthest from those before."""
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    out = {}
    for dim, vs in by.items():
        u = unit(integers(np.array(vs, float).reshape(len(vs), dim)))
        u = u[(u != 0).any(1)] if dim else u[:0]
        picked, far = [], np.full(len(u), np.inf)
        while len(u) and len(picked) < REFERENCES and far.max() > 1e-6:
            k = int(np.argmax(far))
            picked.append(u[k])
            far = np.minimum(far, np.sqrt(((u - u[k]) ** 2).sum(1)))
        out[dim] = np.array(picked).reshape(len(picked), dim)
    return out


def references_for(dim: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Exactly REFERENCES directions: the chosen ones, then seeded random ones."""
    have = known.get(dim, np.zeros((0, dim)))
    more = unit(np.random.default_rng(dim).standard_normal((REFERENCES - len(have), dim)))
    return np.concatenate([have, more])


def usable(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, v) of rows with an id, a label and a vector whose components are all there and finite.

    Of rows that share an id, the one with the smallest label, then the smallest vector, stands for all.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("int").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    return rows


def prepare(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows(vec_id, label, v) as ROW: integer vector, its norm and its angles to the references; written once."""
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()  # SAMPLE rows at most
    known = choose_references([np.array(r["v"], float) for r in first])

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = integers(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
            at = np.concatenate([[0], np.cumsum(size)])
            q, norm, angles = [None] * len(size), np.zeros(len(size)), [None] * len(size)
            for dim in np.unique(size):
                which = np.flatnonzero(size == dim)
                m = flat[at[which][:, None] + np.arange(dim)]
                big = np.sqrt((m * m).sum(1))
                theta = angles_to(unit(m), references_for(int(dim), known))
                for k, row in enumerate(which):
                    q[row], angles[row], norm[row] = m[k].astype("<f8").tobytes(), theta[k].astype("<f8").tobytes(), big[k]
            arrays = [batch.column("vec_id"), batch.column("label"), pa.array(size, pa.int32()), pa.array(q, pa.binary()), pa.array(norm), pa.array(angles, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "dim", "q", "norm", "angles"])

    return scratch.put(rows.mapInArrow(run, ROW))


class Rows:
    """A block of rows in NumPy, in the order of their angles to the first reference."""

    def __init__(self, t: pa.Table):
        matrix = lambda c, w: np.frombuffer(b"".join(t.column(c).to_pylist()), "<f8").reshape(t.num_rows, w)
        theta = matrix("angles", REFERENCES)
        order = np.argsort(theta[:, 0], kind="stable")
        self.theta = theta[order]
        self.q = matrix("q", t.column("dim")[0].as_py())[order]
        self.id, self.label, self.norm = (t.column(c).to_numpy()[order] for c in ("vec_id", "label", "norm"))
        self.longest = float(self.norm.max(initial=0.0))

    def window(self, theta: np.ndarray, norm: float, least: float) -> slice:
        """Rows whose angle to the first reference lets them reach the score `least`; the others need no look."""
        top = norm * self.longest
        if least <= 0:  # a short row may reach it at any angle
            return slice(0, len(self.id))
        if least > top * (1 + SLACK):
            return slice(0, 0)
        wide = np.arccos(min(1.0, least / top - SLACK)) + SLACK
        return slice(*np.searchsorted(self.theta[:, 0], [theta[0] - wide, theta[0] + wide]).tolist())

    def bounds(self, s: slice, theta: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest integer score of the rows of a window."""
        near, far = np.zeros(s.stop - s.start), np.full(s.stop - s.start, np.pi)
        for k in range(REFERENCES):
            x = self.theta[s, k]
            np.maximum(near, np.abs(x - theta[k]), out=near)
            total = x + theta[k]
            np.minimum(far, np.minimum(total, 2 * np.pi - total), out=far)
        p = norm * self.norm[s]
        lo = p * np.cos(np.minimum(far + SLACK, np.pi)) - SLACK * p
        hi = p * np.cos(np.maximum(near - SLACK, 0.0)) + SLACK * p
        return np.ceil(lo), np.floor(hi)

    def scores(self, which: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products: in doubles while every partial sum is exact, else in Python's integers."""
        m = self.q[which]
        if len(m) == 0 or np.abs(m).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(len(q), 1) < 2**53:
            return (m @ q).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in m]
        return np.array(exact, np.int64)  # fails where a score is no long


def nth_largest(x: np.ndarray, n: int) -> float:
    return -np.inf if len(x) < n else float(np.partition(x, len(x) - n)[len(x) - n])


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:n]


def find_positives(rows: Rows, anchor: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    s = slice(0, len(rows.id))
    lo, hi = rows.bounds(s, anchor["theta"], anchor["norm"])
    fits = (rows.label == anchor["label"]) & (rows.id != anchor["id"])
    which = np.flatnonzero(fits & (hi >= nth_largest(lo[fits], n)))
    score = rows.scores(which, anchor["q"])
    top = best(rows.id[which], score, n)
    return rows.id[which[top]], score[top]


def find_negatives(rows: Rows, anchor: dict, wanted: list[tuple[int, int, int]], n: int):
    """wanted: (positive, least, greatest score). Yields (positive, ids, scores) of the n best in each window."""
    wanted = [w for w in wanted if w[1] <= w[2]]
    if not wanted:
        return
    s = rows.window(anchor["theta"], anchor["norm"], min(w[1] for w in wanted))
    if s.stop <= s.start:
        return
    lo, hi = rows.bounds(s, anchor["theta"], anchor["norm"])
    other = rows.label[s] != anchor["label"]
    look = np.zeros(len(lo), bool)
    for _, least, most in wanted:
        sure = other & (lo >= least) & (hi <= most)
        look |= other & (lo <= most) & (hi >= max(least, nth_largest(lo[sure], n)))
    which = np.flatnonzero(look) + s.start
    score = rows.scores(which, anchor["q"])
    for positive, least, most in wanted:
        k = np.flatnonzero((score >= least) & (score <= most))
        k = k[best(rows.id[which[k]], score[k], n)]
        if len(k):
            yield positive, rows.id[which[k]], score[k]


def meet(anchors: DataFrame, rows: DataFrame, key: list[str], visit, schema: str) -> DataFrame:
    """visit(anchor table, Rows) over all pairs of a block of anchors and a block of rows that agree in key (dim among them).

    Blocks are cut by hash from counts, so a hot key is cut like any other; anchors go to each block of rows, rows to each
    block of anchors. No task holds more than one block of each.
    """
    room = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(BLOCK_VALUES) / F.greatest("dim", F.lit(1)))))
    cuts = lambda df, most, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).select(*key, F.ceil(F.col("_c") / room(most)).cast("int").alias(name))
    sizes = cuts(anchors, ANCHOR_BLOCK, "_na").join(cuts(rows, ROW_BLOCK, "_nr"), key)
    sizes = broadcast_if_small(Scratch(rows.sparkSession, "sizes").put(sizes), 1 << 16)
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = anchors.join(sizes, key).withColumn("_a", part("_na", 1)).withColumn("_r", each("_nr")).drop("_na", "_nr")
    rows = rows.toDF(*rows.columns)  # else both sides have the same columns
    r = rows.join(sizes, key).withColumn("_r", part("_nr", 2)).withColumn("_a", each("_na")).drop("_na", "_nr")
    by = [*key, "_a", "_r"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty.slice(0, 0)
        out = list(visit(left, Rows(right)))
        return pa.table([pa.array(np.concatenate([o[k] for o in out]) if out else [], t) for k, t in enumerate(empty.schema.types)], schema=empty.schema)

    empty = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in schema.split(", ")})
    return a.groupBy(*by).cogroup(r.groupBy(*by)).applyInArrow(run, schema)


def _anchors(t: pa.Table):
    for x in t.to_pylist():
        yield {"id": x["vec_id"], "label": x["label"], "q": np.frombuffer(x["q"], "<f8"), "norm": x["norm"], "theta": np.frombuffer(x["angles"], "<f8"), "row": x}


def positives(anchors: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the n best other rows of the anchor's label, fewer if there are no more."""

    def visit(left, block):
        for a in _anchors(left):
            ids, score = find_positives(block, a, n)
            yield np.full(len(ids), a["id"]), ids, score

    found = meet(anchors, rows, ["dim", "label"], visit, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def mine(df: DataFrame, anchor, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where anchor(vec_id) holds.

    Negatives have another label and least to most percent of the positive's score, the highest first, ties by id. Scores are
    inner products of floor(256 x). Only vectors of one dimension meet; those of zero length score 0. Rows without id, label
    or a whole finite vector take no part, rows that share an id count once, other columns are not returned; an empty table
    gives no rows. A score that does not fit a long ends the job.
    """
    scratch = Scratch(df.sparkSession, "negatives")
    rows = prepare(scratch, usable(df, id_col, label_col, vec_col))
    anchors = rows.where(anchor(F.col("vec_id")))
    pos = scratch.put(positives(anchors, rows, n_positives))
    window = F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives")
    asked = anchors.join(pos.groupBy(F.col("anchor_id").alias("vec_id")).agg(window), "vec_id")

    def visit(left, block):
        for a in _anchors(left):
            score = {p["positive_id"]: p["positive_score"] for p in a["row"]["positives"]}
            wanted = [(p, -(-least * s // 100), most * s // 100) for p, s in score.items()]
            for p, ids, found in find_negatives(block, a, wanted, n_negatives):
                yield np.full(len(ids), a["id"]), np.full(len(ids), p), ids, np.full(len(ids), score[p]), found

    found = meet(asked, rows, ["dim"], visit, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark, sf_dir: str) -> DataFrame:
    """Anchors are every hundredth id; the label of every seventh is changed first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), lambda i: i % 100 == 0)
