"""What is compared again, and what is dealt, in near-duplicate removal."""

import random

import corpus_pipeline
from weftline.llm import neardup


def _near_misses(pairs):
    """Texts of 60 words in pairs that share buckets at a similarity of about 0.7, with none at the threshold."""
    rng, rows = random.Random(5), []
    for i in range(pairs):
        words = [f"w{i}x{rng.randrange(10**6)}" for _ in range(64)]
        rows += [(2 * i, " ".join(words[:60])), (2 * i + 1, " ".join(words[:50] + [f"v{w}" for w in words[54:]]))]
    return rows


def test_a_decided_bucket_is_not_looked_at_again(spark, monkeypatch):
    seen, shared = [], neardup._shared_shingles
    monkeypatch.setattr(neardup, "_shared_shingles", lambda texts, nodes: seen.append(nodes.count()) or shared(texts, nodes))
    out = neardup.near_duplicates(spark.createDataFrame(_near_misses(40), "doc_id bigint, text string")).collect()
    assert len(out) == 80 and all(r.kept for r in out)
    assert not seen  # each bucket holds two texts, and its pivot has met the other


def test_texts_are_not_dealt_to_leave_copies_out(spark):
    rows = [(i, f"text number {i // 2} of a few words that stand here", "s") for i in range(40)] + [(None, "no id", "s"), (None, "no id", "s")]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted([str(i) for i in range(0, 40, 2)] + ["None", "None"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
