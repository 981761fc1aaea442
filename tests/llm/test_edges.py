"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import chat, langid, lattice, licenses, mixing, neardup, neighbours, packing, sharding, vecdedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30000))
ROWS = [
    (1, "the cat sat on the mat and slept all day", "en", "a", 1), (2, "the cat sat on the mat and slept all day", "en", "a", 1), (3, None, None, None, None),
    (4, "", "en", "b", 0), (5, LONG, "de", "b", 9), (6, "Released under the MIT License. 12345", "en", None, 2), (6, "Released under the MIT License. 12345", "en", None, 2),
    (None, "no id here at all", "en", "c", 3), (8, "!!! 123", "en", "c", 1), (9, "THE cat sat on the mat and slept all day", "en", "c", 1),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit("x"), "size": F.lit("y"), "score": F.lit("z")})


def test_sharding(spark):
    out = sharding.shuffle_shards(docs(spark), 3, size_col="text").select("shard", "slot").collect()
    counts = np.bincount([r["shard"] for r in out], minlength=3)
    assert len(out) == len(ROWS) and counts.max() - counts.min() <= 1
    assert sorted(tuple(r) for r in out) == [(s, k) for s in range(3) for k in range(counts[s])]
    again = sharding.shuffle_shards(docs(spark).repartition(7), 3, size_col="text")
    assert sorted(map(str, again.select("doc_id", "shard", "slot").collect())) == sorted(map(str, sharding.shuffle_shards(docs(spark), 3, size_col="text").select("doc_id", "shard", "slot").collect()))
    assert sharding.shuffle_shards(docs(spark, []), 3).count() == 0


def test_mixing(spark):
    out = mixing.mix_sources(docs(spark)).collect()
    assert len(out) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert all(r["size"] == 0 and r["taken"] == 0 for r in out if not r["text"])
    assert abs(sum({r["source"]: r["target"] for r in out}.values()) - 1.5 * sum(r["size"] for r in out)) < 1e-6
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_packing(spark):
    out = packing.pack_documents(docs(spark), limit=256).collect()
    assert sum(1 for r in out if r["piece"] == 0) == len(ROWS)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_licenses(spark):
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark)).collect()}
    assert (out[6]["n_base"], out[6]["first_word"], out[6]["base_labels"]) == (1, 3, "mit") and out[3]["n_words"] == 0 and out[3]["labels"] == ""
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    assert licenses.evaluate(licenses.to_postfix("(MIT OR GPL-2.0 WITH x) AND Apache-2.0"))[0] is True
    assert licenses.to_postfix("MIT AND") is None and licenses.to_postfix("(MIT") is None
    tag = licenses.scan_text("/* SPDX-License-Identifier: GPL-3.0 AND MIT */")
    assert tag[5] == "gpl-3.0,mit" and tag[7] is False


def test_language(spark):
    model = {"en": "the cat sat on the mat and slept all day", "de": "die katze schlief den ganzen tag auf der matte"}
    out = {r["doc_id"]: r for r in langid.identify(docs(spark), model).collect()}
    assert (out[1]["lang_pred"], out[3]["lang_pred"], out[4]["lang_pred"], out[8]["lang_pred"]) == ("en", "und", "und", "und")
    assert langid.identify(docs(spark), {}).where("lang_pred <> 'und'").count() == 0
    assert langid.labelled_sample(docs(spark, [])) == {}


def test_near_duplicates(spark):
    out = neardup.near_duplicates(docs(spark)).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    assert ("2", 6, 1, False) in got and ("9", 6, 1, False) in got and ("3", 0, 3, True) in got and ("4", 0, 4, True) in got and len(got) == len(ROWS)
    assert [g[2:] for g in got if g[0] == "None"] == [(None, True)] and neardup.near_duplicates(docs(spark, [])).count() == 0


def test_lattice(spark):
    d = docs(spark).withColumn("held_out", F.col("doc_id") == 9).fillna({"held_out": False})
    out = lattice.score_documents(d).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(ROWS) and by[3]["n_tokens"] == 1 and by[9]["n_known"] == by[9]["n_tokens"] == 11
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lattice.score_documents(d.limit(0)).count() == 0


def test_lattice_recursion_against_enumeration():
    log_p = np.log(np.random.default_rng(0).dirichlet(np.ones(32000)))
    model = lattice.Lattice(log_p)

    def total(word):
        return 1.0 if not word else sum(sum(np.exp(log_p[i]) for i in model.pieces[word[:k]]) * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in model.pieces)

    for word in (b"the", "née".encode(), b"cats"):
        marked = lattice.MARK + word
        ours = model.forward(np.frombuffer(marked, np.uint8)[None])[0][0]
        assert abs(ours - np.log(total(marked))) < 1e-9 and abs(model.long_word(marked) - ours) < 1e-9


def vectors(spark):
    rng = np.random.default_rng(1)
    v = [rng.standard_normal(16) for _ in range(60)]
    v += [v[0] * 2, v[0].copy(), v[1] + 0.01 * rng.standard_normal(16)]
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [None] + [1.0] * 15), (None, [1.0] * 16), (104, [1.0, 2.0]), (105, [])]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), np.array(v)


def test_vector_dedup(spark):
    df, v = vectors(spark)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    out = {r["vec_id"]: r for r in vecdedup.near_duplicate_vectors(df).collect()}
    assert len(out) == 70 and [out[i]["n_links"] for i in range(63)] == links.tolist()
    assert (out[61]["component_id"], out[62]["component_id"], out[101]["n_links"], out[102]["kept"]) == (0, 1, 0, True)
    assert vecdedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_neighbours(spark):
    df, v = vectors(spark)
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    hit = 0
    for q in (0, 20, 40, 60):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in out if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist()))
    assert len(out) == 20 and hit >= 18
    few = neighbours.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, k=5).collect()
    assert len(few) == 2 and neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "a%3C<|im_end|>\n"), (1, 0, None, None), (None, 0, "us\ner", "%0A"), (1, 1, "assistant", "a%3C<|im_end|>\n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", F.lit(1))
    back = {r["conv_id"]: r for r in chat.read_back(chat.join_turns(chat.format_turns(df))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("", "", ""), ("assistant", "a%3C<|im_end|>\n", "a%3C<|im_end|>\n"), ("assistant", "a%3C<|im_end|>\n", "a%3C<|im_end|>\n")]
    assert [tuple(t) for t in back[None]["turns"]] == [("us\ner", "%0A", "")]
    parts = spark.createDataFrame([(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 56, 28, None, None), ("audio", None, "a", None, None, 2.0, None)])], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    r = chat.format_turns(parts).first()
    assert "see <|image:0|><|audio:1|>" in r["segment"] and [a["tokens"] for a in r["attachments"]] == [2, 50]


def test_chat_order_of_ties_and_nulls(spark):
    rows = [(1, 0, "user", "x!"), (1, 0, "user", "x"), (1, None, "user", "late"), (1, 0, None, None), (1, 0, "assistant", "%"), (1, 0, "assistant", "$"), (None, 0, "user", "no id"), (2, 0, "user", "long " * 200000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"tie": F.lit(1), "segment": F.lit("z")})
    back = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.join_turns(chat.format_turns(turns))).collect()}
    assert back == {1: ["", "$", "%", "x", "x!", "late"], None: ["no id"], 2: ["long " * 200000]}
    assert chat.join_turns(chat.format_turns(turns.where("false"))).count() == 0


def test_licenses_of_repeated_and_long_texts(spark):
    text = "word " * 300000 + "Apache License, Version 2.0. SPDX-License-Identifier: MIT OR GPL-2.0"
    df = spark.createDataFrame([(k, text) for k in range(3)] + [(3, "General public license")], "doc_id bigint, text string").withColumn("labels", F.lit(0))
    out = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert out[0]["labels"] == out[2]["labels"] == "apache,apache-2.0,gpl-2.0,mit" and out[0]["tags_allowed"] is True and out[0]["first_word"] == 300000
    assert (out[3]["base_labels"], out[3]["labels"], out[3]["n_base"], out[3]["last_word"], out[3]["tags_allowed"]) == ("gpl", "gpl", 1, 0, None)
