import json

from pyspark.sql import functions as F

from weftline.operators import extract, summary
from weftline.sources import sinks


def test_stats_of_empty_and_small_runs(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("self",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("self", "self"), ("a", "b")], "src string, dst string")
    bundles = spark.createDataFrame([(3, 2, 1)], "n_nodes long, n_edges long, n_missing long")
    written, sources = spark.createDataFrame([("x" * 20,), ("y" * 19,)], "line string"), spark.createDataFrame([("z" * 360,), (None,)], "text string")
    r = summary.run_stats(nodes, edges, bundles, written, sources).first()
    assert (r["total_components"], r["root_components"], r["leaf_components"], r["bundles_generated"], r["total_nodes"], r["missing_dependencies"]) == (4, 1, 1, 1, 3, 1)
    assert (r["tokens_gpt4"], r["tokens_claude"], r["savings_gpt4"], r["savings_claude"]) == (10, 9, "90", "90")
    assert tuple(r["mode_estimates"]["none"]) == (6, 6) and tuple(r["mode_estimates"]["full"]) == (100, 89)
    r = summary.run_stats(nodes.limit(0), edges.limit(0), bundles.limit(0), written.limit(0), sources.limit(0)).first()
    assert (r["total_components"], r["total_nodes"], r["tokens_gpt4"], r["savings_gpt4"]) == (0, 0, 0, "0")


def test_mode_table_in_three_modes(spark):
    stats = spark.createDataFrame([(205, 100)], "tokens_gpt4 long, tokens_claude long")
    rows = lambda *a, **k: [(r["mode"], r["gpt4"], r["savings"]) for r in summary.mode_table(stats, F.lit(400), *a, **k).orderBy("place").collect()]
    assert rows() == [("source", 684, "0"), ("header", 205, "70"), ("header+style", 421, "38")]
    assert rows(with_style=True) == [("source", 334, "0"), ("header", 100, "70"), ("header+style", 205, "39")]
    assert rows("full") == [("source", 100, "0"), ("header", 154, "-54"), ("header+style", 175, "-75")]


def test_missing_names_keep_the_rest_as_a_number(spark):
    lost = spark.createDataFrame([(f"r{k % 3}", f"n{k:02d}") for k in range(12)] + [("r0", "n00"), ("r2", "n00")], "root string, name string")
    out = summary.missing_names(lost).orderBy("place").collect()
    assert [r["name"] for r in out] == ["n00", "n03", "n06", "n09", "n01", "n04", "n07", "n10", "n02", "n05"] and {r["more"] for r in out} == {2}
    assert out[0]["n_bundles"] == 2 and summary.missing_names(lost.limit(0)).count() == 0


def test_a_folder_of_most_rows_is_numbered_in_ranges(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # ranges stay apart, however small
    try:
        rows = spark.range(2000).select(F.when(F.col("id") % 20 == 0, F.concat(F.lit("f"), F.col("id") % 3)).otherwise("hot").alias("folder"), F.format_string("e%05d", (F.col("id") * 7919) % 2003).alias("entry_id"))
        placed = sinks.with_places(rows, "folder", "entry_id")
        got = {}
        for r in placed.collect():
            got.setdefault(r["folder"], []).append((r["place"], r["entry_id"], r["_n"]))
        for folder, items in got.items():
            items.sort()
            assert [p for p, _, _ in items] == list(range(1, len(items) + 1)) and {n for _, _, n in items} == {len(items)}
            assert [e for _, e, _ in items] == sorted(e for _, e, _ in items)
        assert len(got["hot"]) == 1900
        sinks.write_context(rows, str(tmp_path / "out"), "json")
        parts = sorted((tmp_path / "out" / "folder=hot").glob("part-*"))
        whole = json.loads("".join(p.read_text() for p in parts))
        assert len(parts) > 1 and [b["position"] for b in whole] == [f"{k}/1900" for k in range(1, 1901)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_folder_index(spark):
    lines = spark.createDataFrame([(".", "x" * 9), ("src/app/a", "y" * 4), ("src/app/a", "z" * 4), ("lib", "")], "folder string, line string")
    members = spark.createDataFrame([(".", "a.tsx"), ("src/app/a", "src/app/a/page.tsx"), ("src/app/a", "src/app/a/B.tsx"), ("lib", "lib/u.ts")], "folder string, entry_id string")
    out = {r["folder"]: tuple(r)[1:] for r in summary.folder_index(lines, members, "toon").collect()}
    assert out == {".": ("context.toon", 1, True, "Project Root", 3), "src/app/a": ("src/app/a/context.toon", 2, True, "Next.js App", 3), "lib": ("lib/context.toon", 1, False, None, 0)}
    assert sorted(r["component"] for r in summary.folder_components(members).where("folder like 'src%'").collect()) == ["B.tsx", "page.tsx"]
    totals = summary.index_totals(summary.folder_index(lines, members), members).first()
    assert tuple(totals) == (4, 4, 3, 6)


def test_preset_predictions(spark):
    df = spark.createDataFrame([(["onSubmit"], ["busy"], ["to"]), ([], [], [])], "e array<string>, s array<string>, p array<string>")
    of = lambda preset: [len(r[0]) for r in df.select(extract.preset_predictions(preset, F.col("e"), F.col("s"), F.col("p"))).collect()]
    assert [of(p) for p in ("submit-only", "nav-only", "display-only", "none")] == [[4, 1], [3, 2], [3, 3], [0, 0]]
