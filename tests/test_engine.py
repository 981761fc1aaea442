"""Whole runs over source trees, files written and read back, and streams with restarts."""

import json

import weftline
from pyspark.sql import functions as F
from weftline.operators import scan
from weftline.sources import files, sinks
from weftline.streaming import watch

APP = """import { Card } from './components/Card';
import { Lost } from './Lost';
export function App() {
  return <Card><Lost /></Card>;
}
"""
CARD = """import { useState } from 'react';
import { Button } from './Button';
function Inner() { return <b />; }
export function Card() {
  const [open, setOpen] = useState(false);
  return <div><Button onClick={() => setOpen(!open)} /><Inner /></div>;
}
export const other = 1;
"""
BUTTON = """interface ButtonProps {
  label: string;
  onClick?: () => void;
}
export function Button({ label, onClick }: ButtonProps) {
  return <button onClick={onClick}>{label}</button>;
}
"""


def tree(path, **more):
    for name, text in {"src/App.tsx": APP, "src/components/Card.tsx": CARD, "src/components/Button.tsx": BUTTON, "src/utils/helpers.ts": "export function up(s: string) {\n  return s;\n}\n", **more}.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    return str(path)


def short(rows, *columns):
    return sorted(tuple(str(r[c]).rsplit("/", 1)[-1] if c in ("id", "root", "src", "dst", "entry_id", "referenced_by") else r[c] for c in columns) for r in rows.collect())


def test_context_of_a_tree(spark, tmp_path):
    c = weftline.context(spark, tree(tmp_path))
    assert short(c.members, "root", "id", "level") == [("App.tsx", "App.tsx", 0), ("App.tsx", "Button.tsx", 2), ("App.tsx", "Card.tsx", 1), ("helpers.ts", "helpers.ts", 0)]
    assert short(c.edges, "root", "src", "dst") == [("App.tsx", "App.tsx", "Card.tsx"), ("App.tsx", "Card.tsx", "Button.tsx")]
    assert short(c.missing, "root", "name", "referenced_by") == [("App.tsx", "Lost", "App.tsx")]
    assert short(c.bundles(), "entry_id", "n_nodes", "n_edges", "n_missing") == [("App.tsx", 3, 2, 1), ("helpers.ts", 1, 0, 0)]
    assert c.stats().first().asDict() == {"contracts": 4, "bundles": 2, "nodes": 4, "edges": 2, "missing": 1}
    assert short(weftline.context(spark, str(tmp_path), depth=0).members, "id") == [("App.tsx",), ("helpers.ts",)]
    assert short(weftline.context(spark, str(tmp_path), "llm-safe", max_nodes=2).members, "id") == [("App.tsx",), ("Card.tsx",), ("helpers.ts",)]
    again = weftline.context(spark, tree(tmp_path, **{"src/components/Button.tsx": BUTTON.replace("label: string", "label: number")}))
    found = short(weftline.compare(c, again), "op", "facet")  # props are compared by name
    assert ("changed", "semantic_hash") in found and ("changed", "props") not in found
    old, new = ({r["entry_id"].rsplit("/", 1)[1]: r["bundle_hash"] for r in x.bundles().collect()} for x in (c, again))
    assert old["App.tsx"] != new["App.tsx"] and old["helpers.ts"] == new["helpers.ts"]


def test_bundle_files_round(spark, tmp_path):
    rows = spark.createDataFrame([("src", "b", 1), ("src", "a", 2), ("lib", "c", 3)], "folder string, entry_id string, n int")
    for fmt in sinks.FORMATS:
        sinks.write_context(rows, str(tmp_path / fmt), fmt)
    back = spark.read.text(str(tmp_path / "ndjson")).where("folder = 'src'").collect()
    assert [(json.loads(r["value"])["entry_id"], json.loads(r["value"])["position"]) for r in back] == [("a", "1/2"), ("b", "2/2")]
    whole = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "json")).where("folder = 'src'").collect())
    assert [b["n"] for b in json.loads(whole)] == [2, 1]
    (tmp_path / "in/src").mkdir(parents=True)
    good = {"type": "ABundle", "schemaVersion": "0.1", "entryId": "x", "bundleHash": "uifb:" + "0" * 24, "graph": {"nodes": [{"entryId": "x", "contract": {"type": "UIFContract", "schemaVersion": "0.4"}}], "edges": []}, "meta": {"missing": []}}
    (tmp_path / "in/src/context.json").write_text(json.dumps([good, good | {"type": "no", "bundleHash": "bad"}]))
    found = weftline.validate(files.read_bundles(spark, str(tmp_path / "in")), "ABundle")
    assert sorted(tuple(r) for r in found.collect()) == [("bundle hash", "warning", 1), ("bundle type", "error", 1)]
    (tmp_path / "in/index.json").write_text(json.dumps({"type": "AnIndex", "schemaVersion": "0.1", "folders": [{"path": "src", "contextFile": "src/context.json", "bundles": 2, "isRoot": True, "rootLabel": "Main Source"}]}))
    assert tuple(files.read_index(spark, str(tmp_path / "in/index.json"), "AnIndex").first()) == ("src", "src/context.json", 2, True, "Main Source", True)


def test_security_report(spark, tmp_path):
    key = "A" * 24
    hits = weftline.security_scan(spark, tree(tmp_path, **{"src/key.ts": f'const apiKey = "{key}"; const api_key = "{key}B";\n// apiKey = "{key}"\n'}))
    assert short(hits, "id", "line", "column", "type") == [("key.ts", 1, 7, "API Key"), ("key.ts", 1, 50, "API Key")]
    sinks.write_security_report(hits, str(tmp_path / "report"))
    assert short(sinks.security_report(sinks.read_security_report(spark, str(tmp_path / "report")).withColumnRenamed("id", "id")).withColumnRenamed("file", "id"), "id", "secrets", "high") == [("key.ts", 2, 2)]
    text = f'password: "hunter2hunter2"\ntoken= {key}\n-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----\nghp_{"a" * 36}'
    masked = spark.createDataFrame([(text,)], "t string").select(scan.mask_all(F.col("t")).alias("m")).first()["m"]
    assert "hunter2" not in masked and key not in masked and "abc" not in masked and "ghp_" not in masked and masked.count("PRIVATE_DATA") == 4


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    root, table, point, seen = tree(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "point"), []
    then = lambda changed, epoch: seen.append(sorted(r["path"].rsplit("/", 1)[1] for r in changed.collect()))
    run = lambda: watch.start(files.stream_sources(spark, root), table, point, then, once=True).awaitTermination()
    run()
    assert seen == [["App.tsx", "Button.tsx", "Card.tsx", "helpers.ts"]]
    tree(tmp_path / "in", **{"src/New.tsx": APP, "src/notes.md": "x"})
    run()
    assert seen[1:] == [["New.tsx"]] and watch.read_table(spark, table).count() == 5


def test_upsert_keeps_the_newest_and_skips_known_hashes(spark, tmp_path):
    write = watch.upsert_to(str(tmp_path / "t"), "path")
    batch = lambda *rows: spark.createDataFrame(rows, "path string, ts int, file_hash string")
    for turn in (0, 0):  # a batch that runs twice leaves the same table
        write(batch(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), turn)
    write(batch(("a", 3, "y"), ("b", 2, "w")), 1)
    assert sorted(tuple(r) for r in watch.read_table(spark, str(tmp_path / "t")).select("path", "ts", "file_hash").collect()) == [("a", 2, "y"), ("b", 2, "w")]


def test_debounce_on_a_stream(spark, tmp_path):
    schema = "path string, ts timestamp"
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00.3"), ("a", "2024-01-01 00:00:05"), ("z", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "path string, ts string").select("path", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("all", F.lit(1))
    out = watch.debounce(stream, "all", path="path")
    out.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["n"], r["paths"]) for r in spark.table("bursts").collect()) == [(1, ["a"]), (2, ["a", "b"])]
