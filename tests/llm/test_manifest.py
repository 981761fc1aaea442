"""The Merkle manifest against a plain one over sorted rows."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from weftline.llm import manifest

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][a : a + 16]) for a in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, at):
    for nodes in levels[:-1]:
        a = at - at % 16
        yield nodes[a:at], nodes[at + 1 : a + 16]
        at //= 16


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            path = [*climb(trees[s], at), *climb(top, k)]
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                seen = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(seen)
            for a, b in path:
                node = h(*a, node, *b)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*[x for a, b in path for x in (*a, *b)]), node, node == root))
    return sorted(out, key=str)


def digests(spark, tmp_path, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    if extra:
        df = df.withColumns({"slot": F.lit("x"), "n": F.lit("y"), "leaf": F.lit("z"), "_s": F.lit(1)})
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted([tuple(r) for r in manifest.op11(spark, str(tmp_path)).collect()], key=str)


def test_equals_plain(spark, tmp_path):
    rng = random.Random(3)
    ids = rng.sample(range(-50000, 3_000_000), 700)
    rows = [(i, rng.choice(["a", "a", "a", "b", "ä", "z", None]), "en", 3, f"Text {i} Ä") for i in ids]
    rows += [(9_000_000_000_000_000_000 + k, "a", None, None, None) for k in range(3)] + [(-(2**63), "b", None, 1, "X")]
    rows += [(None, "a", "en", 1, f"No id {k % 3}") for k in range(20)] + [(None, None, None, None, None)] * 2
    rows += [(77, "b", "en", 1, "Same")] * 30 + [(77, "b", "en", k, "Other") for k in range(40)] + [(5, "alone", "de", 1, ""), (5, "", "de", 1, "Long " * 50000)]
    assert digests(spark, tmp_path, rows, extra=True) == plain(rows)


def test_one_source_and_empty(spark, tmp_path):
    rows = [(k, "s", "en", k, f"Doc {k}") for k in range(257)]
    assert digests(spark, tmp_path / "a", rows) == plain(rows)
    assert digests(spark, tmp_path / "b", rows[:1]) == plain(rows[:1])
    assert digests(spark, tmp_path / "c", []) == []


def test_directory_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "DIRECTORY", 4)
    rows = [(k * 1500, "s", "en", k, f"Doc {k}") for k in range(-60, 100)] + [(None, "s", "en", 1, "x")]
    assert digests(spark, tmp_path, rows) == plain(rows)


def test_files(spark, tmp_path):
    rows = [(k, f"s{k % 3}", "en", k, f"Doc {k}") for k in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    m = manifest.build_manifest(df.select("doc_id", "source", manifest.leaf_digest(*[F.col(c) for c in manifest.FIELDS]).alias("leaf")))
    m.write(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/leaves")).count() == 40
    assert {r["root"] for r in spark.read.parquet(str(tmp_path / "m/subroots")).collect()} == {m.root} == {plain(rows)[0][3]}
