"""The corpus pipeline: language ID, near-duplicate removal, mixing to target weights, packing.

Each stage works on all that the one before has kept, written as Parquet and read again. The stages' own models (labelled
text, sketches, targets, length histogram) are made from the stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import langid, mixing, neardup, packing
from weftline.llm.shared import Scratch, broadcast_if_small, small_batches

BATCH_BYTES = 1 << 20  # of an Arrow batch: one executor and its workers serve all stages, and what one has touched stays with them


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without text or without a letter in it go. Labels are learned as in op9."""
    small_batches(spark, BATCH_BYTES)
    known = docs.where(~langid.held_out(F.col("doc_id"), 4))
    predicted = langid.identify(docs, langid.labelled_sample(known))
    return predicted.where("lang_pred <> 'und'").select(docs.columns)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; null ids stay.

    Rows that share an id are one document: each of its different texts stays once, the row that the hash of the other
    columns puts first.
    """
    small_batches(spark, BATCH_BYTES)
    scratch = Scratch(spark, "kept")
    rows = scratch.put(neardup.near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null").select("doc_id", "kept"))
    kept = rows.where("kept").select("doc_id")
    # Fewer ids go than stay, so that texts are picked by a broadcast of those and not dealt.
    gone = scratch.put(rows.where("not kept").select("doc_id").distinct().join(kept, "doc_id", "left_anti"))
    out = docs.where("doc_id is not null").join(broadcast_if_small(gone, neardup.MAX_IDS), "doc_id", "left_anti").select(docs.columns)
    if kept.groupBy("doc_id").count().where("count > 1").limit(1).count():
        others = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t])
        first = Window.partitionBy("doc_id", "text").orderBy(others)
        out = out.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    return out.union(docs.where("doc_id is null"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    mixed = mixing.mix_sources(docs).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(docs.columns)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and place there; copies of a document are packed one by one."""
    small_batches(spark, BATCH_BYTES)
    return packing.pack_documents(docs.select("doc_id", "text"), keep_ids=False)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: No SQL: SQL expresses neither the automata of stage 1, the sketches of stage 2, the seeded order of stage 3 nor the fit
#: of stage 4. tests/llm/test_pipeline.py compares every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs)
    return docs
