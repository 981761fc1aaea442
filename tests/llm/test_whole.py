"""Cases in which an operator once did less than the whole job."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import chat, lattice, mixing, neardup, neighbours, vecdedup


def test_neighbours_of_unequal_lengths(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for name, scale in {"one long": np.where(np.arange(4000) == 7, 10.0, 1.0), "some long": np.where(np.arange(4000) % 50 == 7, 5.0, 1.0), "lognormal": rng.lognormal(0, 0.5, 4000)}.items():
        x = v * scale[:, None]
        df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id bigint, embedding array<double>")
        got = {}
        for r in neighbours.nearest(df, F.col("vec_id") % 40 == 0).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        recall = []
        for q in range(0, 4000, 40):
            s = x @ x[q]
            s[q] = -np.inf
            recall.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
        print(name, np.mean(recall), min(recall))
        assert np.mean(recall) >= 0.93, name


def test_mixing_around_a_long_document(spark):
    """Sources with one document of 30 % of the words, of which 30 % are wanted, come near their target wherever it stands."""
    rng = np.random.default_rng(2)
    rows = []
    for source in range(20):
        sizes = np.maximum(1, rng.lognormal(2.5, 0.8, 150)).astype(int).tolist()
        sizes.append(int(sum(sizes) * 0.3 / 0.7))
        rows += [(len(rows) + k, " ".join(["w"] * n), f"s{source:02}") for k, n in enumerate(sizes)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), share=0.3, weights=(1,)).drop("text").collect()
    miss = {}
    for r in out:
        miss[r["source"]] = miss.get(r["source"], r["target"]) - r["taken"]
    target = {r["source"]: r["target"] for r in out}
    print("largest miss", max(abs(miss[s]) / target[s] for s in miss), "mean", np.mean([abs(miss[s]) / target[s] for s in miss]))
    assert all(abs(miss[s]) <= 0.01 * target[s] for s in miss)


def test_long_words_train_pieces(spark):
    model = lattice.Lattice(np.log(np.random.default_rng(0).dirichlet(np.ones(32000))))
    word = lattice.MARK + b"https://example.org/index"
    ours, short = np.zeros(len(model.edge)), model.forward(np.frombuffer(word, np.uint8)[None], np.ones(1))[1]
    model.long_word(word, ours)
    assert np.allclose(ours, short, atol=1e-9) and ours.sum() > 1
    text = "https://example.org/" + "international/development/" * 8
    words = spark.createDataFrame([(1, text, 1)], "hash bigint, word string, n_train bigint")
    log_p = lattice.train_pieces(words)
    assert len(text) > lattice.LONG and log_p.max() > log_p[np.isfinite(log_p)].min() + 1


def test_near_duplicates_with_two_texts_under_one_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    texts = spark.createDataFrame([(1, text), (2, text + " end"), (2, "nothing like the other one at all")], "node bigint, text string").coalesce(1)
    assert sorted(r["ok"] for r in neardup._confirmed(pairs, texts, 75).collect()) == [False, True]


def test_vector_buckets_find_pairs_at_the_threshold():
    """Shares of pairs at cosine 0.9 with a common bucket, for tables of 131072 and 16.8 million rows."""
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 8000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (1 << 17, 1 << 24):
        c = vecdedup.Codes(64, n)
        found = (c.keys(a) == c.keys(b)).any(1).mean()
        print(n, c.bits, c.tables, found)
        assert found >= 0.94, n


def test_chat_query_walks_parts(spark, monkeypatch):
    import duckdb

    from weftline.llm import queries

    calls, visit = [], chat.visit
    monkeypatch.setattr(chat, "visit", lambda *a, **k: calls.append(1) or visit(*a, **k))
    ours = chat.op10(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({queries.SQL['op10_chat']})").fetchall()
    assert calls and sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, want))
