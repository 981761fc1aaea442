"""Incremental rebuilds against whole runs, streams of changes with deletions, strict watches."""

import pytest
from pyspark.sql import functions as F

from weftline import engine
from weftline.sources import changes
from weftline.streaming import incremental

USES = lambda *names: "\n".join(f"<{n} />" for n in names) + "\nexport function X() { return <p/> }\n"
BATCHES = [
    {"src/App.tsx": USES("Card", "Nope"), "src/Card.tsx": USES("Button"), "src/Button.tsx": USES(), "src/Self.tsx": USES("Self"), "src/Alone.tsx": USES("Icon")},
    {"src/Card.tsx": USES("Button", "Icon"), "src/Icon.tsx": USES("Deep")}, {"src/Nope.tsx": USES("Card")}, {"src/Card.tsx": None, "src/Alone.tsx": USES()},
    {"src/Card/index.tsx": USES("Self"), "src/Deep.ts": USES("App"), "src/Loop.tsx": USES("Loop")}, {"src/App.tsx": None, "src/Button.tsx": USES("Button2"), "src/Gone.tsx": None}, {"src/Button.tsx": USES("Button2")},
]


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def same(a: engine.Context, b: engine.Context):
    for name, columns in {"contracts": ("id", "file_hash", "semantic_hash"), "members": ("root", "id", "level"), "edges": ("root", "src", "dst"), "missing": ("root", "name", "referenced_by"), "hashes": ("root", "n_nodes", "bundle_hash")}.items():
        assert rows_of(getattr(a, name), *columns) == rows_of(getattr(b, name), *columns), name


def test_equals_a_whole_run(spark, tmp_path, monkeypatch):
    from weftline.streaming import store

    monkeypatch.setattr(store, "FOLD", 3)
    kept, now = incremental.Incremental(spark, str(tmp_path / "t")), {}
    for epoch, batch in enumerate(BATCHES):
        df = spark.createDataFrame([(p, t, epoch) for p, t in batch.items()], "path string, text string, ts int")
        kept.apply(df, epoch)
        if epoch == 2:
            kept.apply(df, epoch)  # a batch that runs again
        now = {p: t for p, t in (now | batch).items() if t is not None}
        if epoch in (3, 6):
            whole = engine.context_of(spark.createDataFrame(list(now.items()), "path string, text string"))
            same(kept.context(), whole)
    assert rows_of(whole.unreached(), "id") == rows_of(kept.context().unreached(), "id") == [("src/Loop.tsx",)]


def test_stream_with_deletion_and_restart(spark, tmp_path):
    root, point = tmp_path / "in", str(tmp_path / "point")
    (root / "src").mkdir(parents=True)

    def run():
        kept = incremental.Incremental(spark, str(tmp_path / "t"), strict=True)
        stream = changes.stream_changes(spark, str(root), str(tmp_path / "listings"), settle=0)
        incremental.follow(stream, kept, point, once=True).awaitTermination()
        return kept

    for name, text in BATCHES[0].items():
        (root / name).write_text(text)
    kept = run()
    assert kept.table("contracts").count() == 5
    (root / "src/Card.tsx").unlink()
    (root / "src/New.tsx").write_text(USES("Button"))
    kept = run()
    here = spark.createDataFrame([(str(p), p.read_text()) for p in (root / "src").iterdir()], "path string, text string")
    same(kept.context(), engine.context_of(here))
    assert rows_of(kept.table("counts"), "errors", "warnings", "errors_so_far") == [(0, 0, 0), (1, 1, 1)]
    assert rows_of(kept.table("violations"), "type", F.element_at(F.split("id", "/"), -1), "name") == [("contract_removed", "Card.tsx", None), ("missing_dependency", "project", "Card")]
    run()
    assert kept.table("contracts").count() == 5


def test_strict_watch_stops(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a.tsx", "export function A() { useX() }", 1)], "path string, text string, ts int").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([("a.tsx", "export function B() { useX() }", 2)], "path string, text string, ts int").coalesce(1).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema("path string, text string, ts int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    kept = incremental.Incremental(spark, str(tmp_path / "t"), strict=True)
    with pytest.raises(Exception, match="breaks a contract"):
        incremental.follow(stream, kept, str(tmp_path / "c"), once=True, stop_on_error=True).awaitTermination()
    assert {r["type"] for r in kept.table("violations").collect()} == {"breaking_change_function_removed"}


def test_changed_files_are_dealt_by_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "TASK_FILES", 50)
    kept = incremental.Incremental(spark, str(tmp_path / "t"))
    kept.apply(spark.range(400).coalesce(1).select(F.concat(F.lit("src/F"), F.col("id").cast("string"), F.lit(".tsx")).alias("path"), F.lit(USES()).alias("text"), F.lit(0).alias("ts")), 0)
    files = kept.table("contracts").select(F.input_file_name().alias("f")).distinct().count()
    assert kept.table("contracts").count() == 400 and files > 1
