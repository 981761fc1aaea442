"""Tokenizer fertility against plain Python over whole texts."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import fertility

WORD = re.compile("[^\x20\x09-\x0d]+")
ROWS = [
    (1, "en", "One two three\none two three\n\n \none two three \nOne two three"), (2, None, None), (3, None, ""), (4, None, " \n\t"), (5, "en", "a b c d e f g h " * 3),
    (6, None, "привет мир как дела друг мой " * 5), (7, "de", "#*$%&|<> ünï cödé \x0b x y"), (8, "en", "x" * 20000 + " " + "ä" * 9000), (9, None, "12 34 !! ??"),
    (10, "en", "same words here\n" * 40), (11, "en", "same words here\n" * 40), (12, "zz", "漢字かな 交流じり文 " * 12), (13, "en", "abcdefgh\nabcdefgh"), (None, "en", "no id"),
]


def plain(text, model):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {k + m for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for m in range(8)}
    ids = [t for w in words for a in range(0, len(w), 1024) for t in model.encode(w[a : a + 1024])]
    n, c = len(ids), Counter(ids)
    entropy = -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n, sum(model.is_byte(t) for t in ids) / n if n else 0.0, entropy


def model():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def compare(out, rows):
    m = model()
    for r in out:
        want = plain(next(x[2] for x in rows if x[0] == r["doc_id"]), m)
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_tokens"][0])
        assert got == want[:6], r["doc_id"]
        assert abs(r["byte_share"] - want[6]) < 1e-12 and abs(r["entropy"] - want[7]) < 1e-9
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["kept"] and r["base_failed"])


def test_edges(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, lang string, text string").withColumns({"size": F.lit("x"), "script": F.lit(1), "kept": F.lit("y"), "other": F.lit(3)})
    out = fertility.quality(df).collect()
    assert len(out) == len(ROWS) and all(r["other"] == 3 for r in out)
    compare(out, ROWS)
    by = {r["doc_id"]: r for r in out}
    assert (by[6]["band"], by[12]["band"], by[9]["band"], by[12]["script"]) == ("script:cyrillic", "lang:zz", "script:none", "han")
    assert fertility.quality(df.where("false")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], None, r["text"]) for r in docs.select("doc_id", "text").collect()]
    compare(fertility.op12(spark, "/root/testdata/sf0.001").collect(), rows)


def test_bands(spark):
    rng = random.Random(5)
    base = ["the", "house", "water", "under", "people", "number", "between", "children", "mountain", "river", "story", "follow", "point", "world", "school", "country", "plant", "earth"]
    rows = [(k, "en" if k % 3 else None, " ".join(rng.choice(base) for _ in range(60))) for k in range(600)]
    rows += [(1000, "en", " ".join("".join(rng.choice("QZXJKVW") for _ in range(5)) for _ in range(30))), (1001, None, " ".join(["the"] * 5 + ["house", "water"] * 3) + " " + " ".join(rng.choice(["the", "house"]) for _ in range(50)))]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    out = {r["doc_id"]: r for r in fertility.quality(df).collect()}
    assert not out[1000]["kept"] and not out[1001]["kept"] and sum(not r["kept"] and not r["base_failed"] for k, r in out.items() if k < 1000) <= 2
    m, groups = model(), {}
    for k, lang, text in rows:
        w = plain(text, m)
        if not out[k]["base_failed"]:
            groups.setdefault((lang, int(math.log2(w[0]))), []).append(w[1] / w[5])
    for (lang, size), xs in groups.items():
        if len(xs) >= fertility.ENOUGH:
            xs.sort()
            a, b, c = (xs[max(0, math.ceil(p * len(xs)) - 1)] for p in (0.25, 0.5, 0.75))
            lo, hi = a - max(fertility.FENCE * (b - a), (fertility.FLOOR + 2 ** (-size / 2)) * b), c + max(fertility.FENCE * (c - b), (fertility.FLOOR + 2 ** (-size / 2)) * b)
            for k, r in out.items():
                x = r["chars_per_token"][0]
                if (r["band"] == ("lang:en" if lang else "script:latin")) and r["size"] == size and not r["base_failed"] and min(abs(x - lo), abs(x - hi)) > 0.1:
                    assert any("characters" in why for why in r["reasons"]) == (not lo <= x <= hi)


def test_every_public_vocabulary_judges(spark):
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    named = lambda files: {x.rsplit(".", 1)[0] for x in files}
    assert named(x for x in os.listdir(public_tokenizers.path("")) if x.endswith((".json", ".tiktoken", ".model"))) == named(fertility.VOCABULARIES)
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word.encode_special_tokens = True
    encoders = [model().encode, lambda w: word.encode(w, add_special_tokens=False).ids]
    for name in fertility.VOCABULARIES[2:]:
        with open(public_tokenizers.path(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoders.append(tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
    rng = random.Random(5)
    usual = ["the", "house", "water", "under", "people", "number", "between", "children", "mountain", "river", "story", "follow", "point", "world", "school"]
    texts = [*[t for _, _, t in ROWS], "it's DON'T <|endoftext|> x<|startoftext|>y \u00a012345 İstanbul ﬁ é \x1c\x85 ''s 🎉🎉"]
    texts += [" ".join(rng.choice(usual) for _ in range(40)) for _ in range(200)] + [" ".join("".join(rng.choice("qzxjkvw") for _ in range(5)) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in fertility.quality(df, lang_col=None).collect()}
    for i, r in out.items():
        for k, encode in enumerate(encoders):
            ids = [t for w in WORD.findall(texts[i] or "") for a in range(0, len(w), 1024) for t in encode(w[a : a + 1024])]
            entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values()) if ids else 0.0
            assert (r["n_tokens"][k], len(r["n_tokens"])) == (len(ids), 4) and abs(r["entropies"][k] - entropy) < 1e-9, (i, k)
    assert {f"characters per token of {name}" for name in fertility.VOCABULARIES} <= set(out[len(texts) - 1]["reasons"])
    assert fertility.Vocabulary("byte_bpe_50k.json").encode(["Don't", "12345"]) == [encoders[2]("Don't"), encoders[2]("12345")]
