"""Operators against plain versions of the same rule."""

import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from weftline.llm import langid, licenses, neardup, packing, sharding, vecdedup

SF = "/root/testdata/sf0.001"


def plain_codes(parser, text):
    codes = parser.code[langid._points(text + "\n")]
    keep = langid._squeezed(codes)
    keep[0] = codes[0] > 0
    return codes[keep].tolist()


def plain_phrases(codes, labelled):
    count = at = 0
    while at < len(codes):
        size = 1
        while at + size <= len(codes) and any(labelled[k : k + size] == codes[at : at + size] for k in range(len(labelled))):
            size += 1
        at, count = at + max(1, size - 1), count + 1
    return count


def test_parse_is_the_plain_greedy_one(monkeypatch):
    rng = random.Random(1)
    for segment, lanes in ((4, 8), (7, 1 << 14), (256, 1 << 14)):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        monkeypatch.setattr(langid, "LANES", lanes)
        labelled = {k: "".join(rng.choice("abc " + own) for _ in range(50)).strip() for k, own in (("x", "d"), ("y", "é"))}
        parser = langid.CrossParser(labelled)
        texts = ["".join(rng.choice("abcdéq  ") for _ in range(n)) for n in (0, 1, 5, 40, 300)] + [labelled["x"] * 2, labelled["y"]]
        codes = [plain_codes(parser, t) for t in texts]
        size = np.array([len(c) for c in codes])
        got = parser.phrases(np.array(sum(codes, []), dtype=np.int64), np.cumsum(size) - size, size)
        for g, k in enumerate(parser.languages):
            own = plain_codes(parser, labelled[k])
            while own and own[-1] == 0:
                own.pop()
            assert [plain_phrases(c, own) for c in codes] == got[g].tolist()


def test_language_of_large_scripts_and_of_copies(spark):
    """Two languages of 400 letters each in one cycle are told apart; 500 copies of a text count once in the sample."""
    cycle = lambda start, n: "".join(chr(start + k % 400) for k in range(n))
    parser = langid.CrossParser({"a": cycle(0x4E00, 900), "b": cycle(0x6000, 900)})
    assert [n for n, _ in parser.scores([cycle(0x4E00, 50), cycle(0x6000, 50), cycle(0x6000, 5000)])] == ["a", "b", "b"]
    rows = [("same text again and again", "en")] * 500 + [(f"text number {k}", "en") for k in range(100)]
    sample = langid.labelled_sample(spark.createDataFrame(rows, "text string, lang string"))
    assert sample["en"].count("same text") <= 1 and 60 <= sample["en"].count("text") <= 64


def test_labelled_sample_takes_passages_of_texts_of_any_length(spark):
    """Passages come from anywhere in a long text, none for its size; equal ones count once; many languages have one each."""
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(long, "x"), ("short one", "x"), ("word " * 20_000, "y"), ("", "z"), (None, "z")]
    sample = langid.labelled_sample(spark.createDataFrame(rows, "text string, lang string"))
    passages = [sample["x"][k : k + 1000] for k in range(0, len(sample["x"]), 1001)]
    assert len(passages) == 64 and all(long.count(p) == 1 and long.index(p) % 1000 == 0 for p in passages)
    places = sorted(long.index(p) for p in passages)
    assert places[0] < len(long) / 4 and places[-1] > 3 * len(long) / 4
    assert sample["y"] == "word " * 200 and sample["z"] == ""
    many = langid.labelled_sample(spark.createDataFrame([(f"text {k} {j}", f"l{k}") for k in range(30) for j in range(5)], "text string, lang string"), total=20)
    assert len(many) == 30 and all(len(v.split()) == 3 for v in many.values())


def test_tokens_equal_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ours, plain, rng = packing.Tokens(path), Tokenizer.from_file(path), random.Random(3)
    texts = ["x<|endoftext|>y", "<|startoftext|>", "<|ENDOFTEXT|>", "don't I'LL 've", "", " "]
    texts += ["".join(rng.choice("abc ABC 019 '.,!<|>_-é ſ中\n\tß\x1c") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert [a.tolist() for a in ours.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_hot_group_of_near_copies(spark):
    """A group whose members share most shingles, many without a link: links and components as by brute force, few pairs."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.randint(2, 12)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    root = list(range(400))
    for a in range(400):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # candidates come from bands, so a link at the very threshold may stay unseen; none may be made up
    assert all(root[out[k]] == root[k] for k in out)
    assert sum(out[k] == root[k] for k in out) >= 392


def test_planted_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1000, 64))
    y -= (y * x[:1000]).sum(1, keepdims=True) * x[:1000]
    cos = rng.uniform(0.9, 0.95, 1000)[:, None]
    y = x[:1000] * cos + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y, axis=1, keepdims=True)
    crowd = x[3000] + 0.35 * rng.standard_normal((400, 64)) / 8
    v = np.concatenate([x, y, crowd])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    out = vecdedup.near_duplicate_vectors(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id bigint, embedding array<double>").withColumns({"node": F.lit("n"), "dim": F.lit("d"), "vec": F.lit(0)}))
    got = np.array([r["n_links"] for r in out.orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()


def test_shards_hold_every_document_once(spark):
    ours = sharding.op1(spark, SF).collect()
    con = duckdb.connect()
    want = con.sql(f"SELECT doc_id, strlen(coalesce(text, '')) + 8 FROM '{SF}/documents.parquet'").fetchall()
    assert sorted((r["doc_id"], r["size"]) for r in ours) == sorted(want)
    counts = np.bincount([r["shard"] for r in ours], minlength=24)
    assert counts.max() - counts.min() <= 1
    assert sorted((r["shard"], r["slot"]) for r in ours) == [(s, k) for s in range(24) for k in range(counts[s])]
    texts = dict(con.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in ours)


def test_equal_rows_scatter(spark, tmp_path):
    """6000 rows equal in all columns lie in every shard, in runs no longer than chance makes them, and are all written."""
    hot = spark.range(6000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("copy").alias("text"))
    rest = spark.range(3000).select((F.col("id") + 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sharding.write_shards(hot.union(rest), str(tmp_path / "shards"), 6, size_col="text")
    out = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(6) for k in range(1500)]
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted([(1, "copy")] * 6000 + [(k + 2, f"text {k}") for k in range(3000)])
    share = np.bincount([r["shard"] for r in out if r["doc_id"] == 1], minlength=6)
    assert share.min() > 850 and share.max() < 1150


def test_licence_phrases_by_brute_force(spark):
    import re

    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        got = licenses.scan_text(r["text"])
        assert got[:2] == (len(words), len(places)) and got[4] == ",".join(sorted({x for _, x in places}))
        assert (got[2], got[3]) == ((min(places)[0], max(places)[0]) if places else (None, None))
