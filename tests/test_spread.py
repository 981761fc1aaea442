"""Keys are dealt over all tasks before texts are derived from them."""

import pytest
from pyspark.sql import functions as F

from weftline.plans.registry import QUERIES, spread, t

SF = "/root/testdata/sf0.001"


def test_keys_of_one_file_are_dealt(spark):
    rows = spread(spark.range(9000).coalesce(1).select(F.col("id").alias("k")), "k")
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("k").alias("n")).collect()]
    assert len(sizes) == 4 and sum(sizes) == 9000 and max(sizes) < 3000


@pytest.mark.parametrize("name", ["ui_libraries", "style_facets", "class_expressions", "extract_props", "contract_api", "metadata_values", "express_routes", "class_rollup", "extract_long_texts"])
def test_texts_are_made_in_many_tasks(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert t(spark, SF, "customer").rdd.getNumPartitions() == 1 and "RepartitionByExpression [" in plan


def test_masked_files_are_dealt_by_number(spark, monkeypatch):
    from weftline.operators import report

    monkeypatch.setattr(report, "TASK_ROWS", 50)
    files = spark.range(400).coalesce(1).select(F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit('apiKey = "SECRETabcdefghij'), F.col("id").cast("string"), F.lit('"')).alias("text"))
    found = files.select(F.col("path").alias("file"), F.lit(1).cast("long").alias("line"), F.lit(1).cast("long").alias("column"), F.lit("API Key").alias("type"), F.col("text").alias("snippet"))
    out = report.mask_by_report(files, found, "/old", "/new").withColumn("task", F.spark_partition_id())
    rows = out.collect()
    assert {(r.n_masked, r.masked) for r in rows} == {(1, 'apiKey = "PRIVATE_DATA"')} and len(rows) == 400
    sizes = {k: sum(r.task == k for r in rows) for k in {r.task for r in rows}}
    assert len(sizes) == 8 and max(sizes.values()) < 100


def test_keys_of_a_report_are_dealt(spark):
    plan = QUERIES["mask_by_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in plan
