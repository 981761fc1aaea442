"""The corpus pipeline against a plain version of each stage, on documents with copies, near copies, junk and nulls."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {"en": "the cat sat on mat and slept all day while rain fell over green hills near old stone bridge".split(), "de": "die katze schlief den ganzen tag auf der matte und regen fiel über grüne hügel neben alter brücke".split()}


def make_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(90):
        lang = rng.choice(["en", "de"])
        rows.append([k, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(3, 120))), lang, rng.choice(["a", "a", "b", "ü", None]), 0])
    for k in range(90, 120):  # exact copies, and near copies on both sides of the threshold
        text = rows[rng.randrange(60)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = f"new{rng.randrange(1000)}"
        rows.append([k, " ".join(text), "en", rng.choice(["a", "b"]), 0])
    rows += [[200, None, "en", "a", 0], [201, "", "de", "a", 0], [202, "123 !!! 456", "en", "b", 0], [203, " ".join(f"word{i} und{i % 7}" for i in range(2500)), "de", "b", 0]]
    return [tuple(r) for r in rows]


def plain_language(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_dedup(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / max(sum(w[s] for s in free), 1)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def plain_mix(spark, rows):
    number = {r["doc_id"]: r["h"] for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", F.xxhash64(F.lit(29), "doc_id", "text").alias("h")).collect()}
    out = []
    size = {r[0]: len(r[1].split()) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    targets = plain_targets({s: sum(size[r[0]] for r in part) for s, part in by.items()})
    for s, part in by.items():
        # Expected copies: level x weight of the length class, at most 2; bisect for the level that spends the target.
        weight = {r[0]: min(8, 1 + int(np.log2(max(size[r[0]], 1)))) / 8 for r in part}
        low, high = 0.0, 16.0
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(size[r[0]] * min(2, level * weight[r[0]]) for r in part) < targets[s] else (low, level)
        mean = {k: min(2, round(high * w, 9)) for k, w in weight.items()}
        whole = {k: int(m) for k, m in mean.items()}
        p = {k: m - int(m) for k, m in mean.items()}
        out += [r for r in part for _ in range(whole[r[0]])]
        rest = targets[s] - sum(whole[r[0]] * size[r[0]] for r in part)
        u = {r[0]: (((number[r[0]] % (1 << 64)) >> 11) + 0.5) / (1 << 53) for r in part}
        drawn = [r for r in part if p[r[0]] > 0]
        order = sorted(drawn, key=lambda r: (u[r[0]] / (1 - u[r[0]]) / (p[r[0]] / (1 - p[r[0]])), number[r[0]]))
        took, at, most = set(), 0, float("inf")
        while True:  # down the ranks to what does not fit, then on with what is small enough for the gap
            room = rest - sum(size[k] for k in took)
            while at < len(order) and not (0 < size[order[at][0]] <= most and size[order[at][0]] > room):
                if 0 < size[order[at][0]] <= most:
                    took.add(order[at][0])
                    room -= size[order[at][0]]
                at += 1
            at, most = at + 1, room
            left = [r for r in order if r[0] not in took and size[r[0]]]
            near = sorted((abs(size[r[0]] - room), n, r[0]) for n, r in enumerate(left) if abs(size[r[0]] - room) < room)
            on = near and near[0][0] >= min(size[r[0]] for r in left) and near[0][0] > mixing.NEAR * targets[s]
            if not (on and any(size[r[0]] <= most for r in order[at:])):
                took |= {near[0][2]} if near else set()
                break
        out += [r for r in order if r[0] in took]
    return out


def plain_pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = np.array([*tok.encode(r[1], add_special_tokens=False).ids, 0], dtype="<u4")
        out += [(r[0], p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    return out


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pipeline_against_plain_version(spark, tmp_path):
    rows = make_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    known = plain_language(rows)
    assert {r[0] for r in rows} - {r[0] for r in known} == {200, 201, 202}
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == sorted(r[0] for r in known)
    single = plain_dedup(known)
    assert len(single) < len(known) - 10
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(known, SCHEMA), "").collect()) == sorted(r[0] for r in single)
    mixed = plain_mix(spark, single)
    stage = corpus_pipeline.mix(spark, spark.createDataFrame(single, SCHEMA), "")
    assert stage.columns == docs.columns
    assert Counter(r["doc_id"] for r in stage.collect()) == Counter(r[0] for r in mixed)

    out = corpus_pipeline.run(spark, write(spark, tmp_path, rows)).collect()
    pieces = plain_pieces(mixed)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == Counter(pieces)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    least = -(-sum(p[3] for p in pieces) // 2048)
    assert least <= len(by) <= least + 1


def test_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 400}
    plan = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in plan) and len(plan) == 4


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, repeated rows and clashing column names run; so does an empty table."""
    rows = [(None, "no id but text", "en", None, None), (1, "same words here again and again", None, "a", 1), (1, "same words here again and again", None, "a", 1), (2, None, None, None, None), (3, "x", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("s"), "kept": F.lit("k"), "score": F.lit(1)})
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r["doc_id"] for r in out} <= {None, 1, 3} and len(out) >= 3
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_stages_take_small_batches(spark):
    import corpus_pipeline as pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64MB")
    try:
        pipeline.pack(spark, spark.createDataFrame([(1, "one two")], "doc_id bigint, text string"), "")
        assert int(spark.conf.get(key)) == 1 << 20
    finally:
        spark.conf.unset(key)
