from pyspark.sql import functions as F

from weftline.operators import extract, graph, scan, style
from weftline.sources import files

CARD = """import { useState } from 'react';
import { Button } from './Button';
export function Card({ title }: CardProps) {
  const [expanded, setExpanded] = useState(false);
  return <div><Button onClick={() => setExpanded(!expanded)} /></div>;
}
"""
ROUTES = """import express from 'express';
router.get('/', list);
router.put('/:id', (req, res) => {});
"""


def test_contracts(spark, tmp_path):
    (tmp_path / "src/cli").mkdir(parents=True)
    (tmp_path / "src/Card.tsx").write_text(CARD)
    (tmp_path / "src/routes.ts").write_text(ROUTES)
    (tmp_path / "src/cli/run.ts").write_text("const x = 1;\n")
    (tmp_path / "src/Card.test.tsx").write_text(CARD)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in extract.contracts(files.read_sources(spark, str(tmp_path))).collect()}
    assert set(rows) == {"Card.tsx", "routes.ts", "run.ts"}
    card = rows["Card.tsx"]
    assert (card["kind"], card["hooks"], card["components"], card["imports"], card["functions"]) == ("react:component", ["useState"], ["Button"], ["./Button", "react"], ["Card"])
    assert [tuple(s) for s in card["state"]] == [("expanded", "boolean")]
    assert [(r["method"], r["path"], r["handler"], r["params"]) for r in rows["routes.ts"]["routes"]] == [("GET", "/", "list", []), ("PUT", "/:id", "anonymous", ["id"])]
    assert rows["routes.ts"]["kind"] == "node:api" and rows["run.ts"]["kind"] == "node:cli"


def test_file_hash_drops_first_header(spark):
    df = spark.createDataFrame([("/** @uif x */\nlet a;\r\n",), ("let a;\n",)], "text string")
    assert df.select(scan.file_hash(F.col("text")).alias("h")).distinct().count() == 1


def test_resolution_prefers_tsx(spark):
    files = spark.createDataFrame([("a/Card.ts",), ("b/Card.tsx",), ("c/Card.vue",)], "path string")
    names = spark.createDataFrame([("Card",), ("Nope",)], "name string")
    assert {r["name"]: r["path"] for r in graph.resolve(names, files).collect()} == {"Card": "b/Card.tsx", "Nope": None}


def test_reach_grows_with_depth_and_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert [graph.reach(start, edges, k).count() for k in range(5)] == [1, 2, 3, 3, 3]


def test_secrets_and_masking(spark):
    df = spark.createDataFrame([(1, 'x\nconst apiKey = "abcdefghijklmnopqrstuvwxyz";\n'), (2, "clean"), (3, None)], "id int, text string")
    assert [(r["id"], r["line"], r["type"]) for r in scan.secret_matches(df).collect()] == [(1, 2, "API Key")]
    assert "PRIVATE_DATA" in df.select(scan.mask(F.col("text")).alias("m")).first()["m"]


def test_classes_and_paths(spark):
    df = spark.createDataFrame([("md:hover:flex",), ("!p-4",), ("bg-red-500",), ("foo",)], "c string")
    assert [r[0] for r in df.select(style.class_category(F.col("c"))).collect()] == ["layout", "spacing", "colors", "other"]
    one = spark.createDataFrame([("src/app/(shop)/cart/page.tsx",)], "p string").select(extract.route_role(F.col("p")), extract.segment_path(F.col("p"))).first()
    assert tuple(one) == ("page", "/cart")


def test_every_query_agrees_with_sql(spark):
    import duckdb

    from weftline.plans.registry import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, run in QUERIES.items():
        if name == "incremental_rebuild":  # tests/test_incremental.py compares more
            continue
        ours = run(spark, sf)
        names = ", ".join(f'"{c}"' for c in ours.columns)
        want = con.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, want)), name


def test_extractors_take_null_and_empty_texts(spark):
    rows = [("src/a.ts", None), ("src/b.ts", ""), ("src/c.ts", "<"), ("src/d.tsx", "x".join(["/*"] * 50))]
    out = {r["path"]: r for r in extract.contracts(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert len(out) == 4 and out["src/a.ts"]["error"] == "no text" and out["src/b.ts"]["error"] is None
    assert out["src/b.ts"]["kind"] == "ts:module" and out["src/b.ts"]["functions"] == [] and out["src/b.ts"]["exports"]["form"] is None
    assert style.style(spark.createDataFrame(rows, "path string, text string")).where("class_count > 0").count() == 0


def test_style_sheets_and_libraries(spark):
    text = "import './a.scss';\nimport { Button as B, Card } from '@mui/material';\nimport styled from 'styled-components';\nimport { motion } from 'framer-motion';\nconst Box = styled.div`color: ${props => props.theme.c};`;\nexport const X = () => <motion.div whileHover={{ scale: 2 }}><B/><B/><Card className={cn('p-1', ok && \"md:flex\")}/><style jsx global>{`.x { color: red; }`}</style></motion.div>;"
    src = spark.createDataFrame([("src/X.tsx", text)], "path string, text string")
    sheet = spark.createDataFrame([("src/a.scss", "$w: 1px;\n.box { &:hover { color: red; } margin: 0; }\n@media print { .y { top: 1px; } }")], "path string, text string")
    r = style.with_sheets(style.style(src), sheet).first()
    assert sorted(r["classes"]) == ["md:flex", "p-1"] and r["style_sheet"] == "./a.scss" and r["sheet"]["has_nesting"] and r["sheet"]["has_variables"] and r["sheet"]["has_media"]
    assert r["sheet"]["properties"] == ["color", "margin", "top"] and r["styled"]["tags"] == ["div"] and r["styled"]["theme"] and r["motion"]["gestures"] and r["motion"]["tags"] == ["div"]
    up = spark.createDataFrame([("src/a/X.tsx", "../css/./y.css")], "path string, style_sheet string")
    held = spark.createDataFrame([("src/css/y.css", ".q { top: 1px; }")], "path string, text string")
    assert style.with_sheets(up, held).first()["sheet"]["selectors"] == [".q"]
    assert r["styled_jsx"]["global"] and r["styled_jsx"]["details"]["properties"] == ["color"] and r["animation"]["library"] == "motion"
    assert [(x["component"], x["n"]) for x in style.ui_usage(src, "path", "@mui/material", 20).orderBy("rank").collect()] == [("Button", 2), ("Card", 1)]


def test_long_and_broken_texts(spark):
    from weftline.operators import lexer

    rows = [
        ("literal", "const q = `" + "select * from t where x = 'y' " * 35000 + "`; const after = 1;"), ("members", "interface BigProps {\n" + "".join(f"  m{i}: Map<string, {{ a: number }}>;\n" for i in range(10000)) + "}\nconst z = 1"),
        ("quotes", "it's `broken \" quotes { ( [ \n" * 3001 + "const k = 1;"), ("nest", "f(" * 5000 + ")" * 5000 + "; const n = 2;"), ("escapes", "const s = '" + "\\'" * 200000 + "'; const t = 1"), ("null", None), ("empty", ""),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    out = {r["path"]: r for r in extract.contracts(df).collect()}
    assert len(out) == len(rows) and out["null"]["error"] == "no text" and out["null"]["hooks"] is None and out["empty"]["variables"] == []
    assert out["literal"]["variables"] == ["after", "q"] and len(out["members"]["props"]) == 10000 and out["members"]["variables"] == ["z"]
    assert out["escapes"]["variables"] == ["s", "t"] and "n" in out["nest"]["variables"]
    assert style.style(df).count() == len(rows)
    made, text = lexer.scanned(df.where("path = 'literal'"))
    assert made.select(text.bare).first()[0] == 'const q = ""; const after = 1;'


def test_forms_within_forms(spark):
    text = """// const [z, setZ] = useState(1)
import a from 'a'; import { b } from "b"
export const c = 1, d = 2
const re = /ab"c/g, url = 'http://x' // not a comment
export const useX = async (p?: string, q = 3): Promise<void> => {}
interface XProps { 'data-id': string; on(x: number): void; kind?: 'a' | 'b' }
function K() { const [m, setM] = useState<Map<string, number>>(new Map()); const [s, setS] = useState([]); useA<Foo<Bar>>(); x.useB(); return <p/> }
"""
    r = extract.contracts(spark.createDataFrame([("src\\\\cli\\\\a.ts", text)], "path string, text string")).first()
    assert (r["imports"], r["hooks"], r["variables"], r["exports"]["named"]) == (["a", "b"], ["useA", "useState"], ["c", "d", "re", "url", "useX"], ["c", "d", "useX"])
    assert [tuple(s) for s in r["state"]] == [("m", "Map<string, number"), ("s", "array")]
    assert [(p["name"], p["type"], p["optional"]) for p in r["props"]] == [("'data-id'", "string", None), ("kind", "literal-union", True), ("p", "string", True), ("q", "number", True)]
    assert r["functions"] == ["K", "useX"]


def test_token_delta_of_missing_sides(spark):
    old = spark.createDataFrame([("a", "x" * 10), ("a", "y" * 7), ("gone", "z")], "folder string, text string")
    new = spark.createDataFrame([("a", "x" * 30), ("new", "{}")], "folder string, text string")
    out = {r["folder"]: (r["gpt_old"], r["gpt_new"], r["gpt_delta"], r["percent"]) for r in scan.token_delta(old, new).collect()}
    assert out == {"a": (5, 8, 3, 60.0), "gone": (1, 0, -1, -100.0), "new": (0, 1, 1, 0.0)}
