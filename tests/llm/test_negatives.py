"""Hard negatives against plain Python over all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def plain(rows):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        best[i] = min(best.get(i, (label, v)), (label, v))
    q = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in best.items()}
    out = []
    for a in (i for i in q if i % 100 == 0):
        score = {b: sum(x * y for x, y in zip(q[a][1], q[b][1])) for b in q if b != a and len(q[b][1]) == len(q[a][1])}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if q[b][0] == q[a][0]][:5]:
            fits = [b for b in order if q[b][0] != q[a][0] and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fits[:10])]
    return sorted(out)


def mined(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "dim": F.lit(1), "norm": F.lit("y")})
    df.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in negatives.op13(spark, str(tmp_path)).collect())


def vectors(rng, n, dim, start=0, centres=12):
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    for k in range(n):
        m = rng.choice(middle)
        yield start + k, rng.randrange(10), [x * rng.choice([0.2, 0.25, 1.0]) + rng.gauss(0, 0.3) for x in m]


def test_equals_plain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 150)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    rng = random.Random(7)
    rows = list(vectors(rng, 900, 8)) + list(vectors(rng, 300, 3, 2000))
    rows += [(5000 + k, 3, [0.5] * 8) for k in range(120)] + [(6000, 3, [0.5] * 8), (6001, 4, [0.0] * 8), (6100, 4, [0.0] * 8)]
    rows += [(None, 1, [1.0] * 8), (7000, None, [1.0] * 8), (7001, 1, None), (7100, 1, [None] + [1.0] * 7), (7200, 2, [math.inf] * 8), (7300, 2, [math.nan] * 8), (7400, 1, []), (7401, 1, []), (7402, 2, [])]
    rows += [(100, 1, [9.0] * 8), (100, 0, [1.0] * 8), (300, 2, [0.1] * 8), (300, 2, [0.1] * 8)]
    assert mined(spark, rows, tmp_path) == plain(rows)


def test_empty_and_long(spark, tmp_path):
    assert mined(spark, [], tmp_path / "a") == []
    rng = random.Random(1)
    rows = [(k * 50, k % 3, [rng.gauss(0, 1) for _ in range(6000)]) for k in range(12)]
    assert mined(spark, rows, tmp_path / "b") == plain(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 32))
    v = centres[rng.integers(0, 6, 3000)] + 0.05 * rng.standard_normal((3000, 32))
    v = np.concatenate([v, -v[:50], v[:50], 1e-3 * v[:20], np.zeros((5, 32))])
    q = negatives.integers(v)
    refs = negatives.references_for(32, negatives.choose_references(list(v[:500])))
    u, norm = negatives.unit(q), np.sqrt((q * q).sum(1))
    theta = negatives.angles_to(u, refs)
    t = pa.table({"vec_id": range(len(q)), "label": [0] * len(q), "dim": [32] * len(q), "q": [x.tobytes() for x in q], "norm": norm, "angles": [x.tobytes() for x in theta]})
    rows = negatives.Rows(t)
    looked = 0
    for k in range(0, len(q), 40):
        lo, hi = rows.bounds(slice(0, len(q)), theta[k], norm[k])
        true = (rows.q @ q[k]).astype(np.int64)
        assert (lo <= true).all() and (true <= hi).all()
        least = np.partition(true, -20)[-20]
        s = rows.window(theta[k], norm[k], least)
        assert set(np.flatnonzero(true >= least)) <= set(range(s.start, s.stop))
        looked += (hi >= least).mean()
    assert looked / len(range(0, len(q), 40)) < 0.45  # of rows in six tight clusters


def test_large_components(spark, tmp_path):
    rows = [(0, 1, [1e6, 2e6]), (1, 1, [2.0, 3e6]), (2, 2, [3e6, -1e5]), (3, 2, [1.5e6, 1e6]), (4, 3, [5e5, 5e5])]
    assert mined(spark, rows, tmp_path) == plain(rows)
