"""Queries over source files derived from a table: every customer stands for a file whose text and path follow from its key.

The SQL knows nothing of the texts: it says what each file must give, from the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import root_label
from weftline.operators import contract as C
from weftline.operators import extract as X
from weftline.operators import scan as S
from weftline.operators import style as Y
from weftline.operators.lexer import scanned
from weftline.plans.registry import query, spread, t
from weftline.sources import sinks

# (condition on the key k, line); # stands for the key.
REACT = [
    ("k % 4 = 0", "'use client';"), ("true", "import React from 'react';"), ("k % 2 = 0", 'import { useState, useEffect } from "react";'),
    ("k % 3 = 0", "import { Card } from '../ui/Card';"), ("k % 5 = 0", "import './side.css';"), ("true", "// import { Nope } from 'nope';"),
    ("true", "/* useFake() <Fake/> */"), ("true", 'const label = "useString() <Text/>";'), ("true", "interface C#Props {"), ("true", "  title: string;"),
    ("k % 2 = 1", "  size?: 'sm' | 'lg';"), ("k % 3 = 0", "  onSelect: (id: number) => void;"), ("k % 7 = 0", "  onHover?: () => void;"),
    ("k % 5 = 0", "  count: number | undefined;"), ("true", "}"), ("k % 4 <> 1", "export function C#({ title }: C#Props) {"),
    ("k % 4 = 1", "export default function C#({ title }: C#Props) {"), ("k % 2 = 0", "  const [open, setOpen] = useState(false);"),
    ("k % 6 = 0", "  const [loading, setLoading] = useState<boolean>(false);"), ("k % 2 = 0", "  useEffect(() => {}, []);"),
    ("true", '  return <div className="flex md:p-4 bg-red-500 rounded-lg" style={{ color: \'red\', width: w }}>'),
    ("k % 3 = 0", "    <Card onClick={onSelect} onSelect={(a) => a} />"), ("k % 7 = 0", "    <button onHover={onHover}>x</button>"),
    ("true", '    <a href="/home/#">go</a> <a href="https://x.y">n</a>'), ("true", "  </div>;"), ("true", "}"), ("k % 5 < 2", "export const helper# = (x: number) => x;"),
]
FILES = {
    2: [("true", "export function formatDate#(d: Date) {"), ("true", "  return d;"), ("true", "}"), ("true", "export type T# = string;")],
    3: [("true", "import { useRef } from 'react';"), ("true", "export function useThing#(a: number, b = 'x') {"), ("true", "  const r = useRef(null);"), ("true", "}")],
    4: [("true", "const args = process.argv;"), ("true", "export const run# = async (x: string[]): Promise<void> => {};")],
    5: [
        ("true", "import { ref, computed } from 'vue';"), ("true", "export function setup#() {"), ("true", "  const count# = ref<number>(0);"), ("true", "  const name = ref('x');"),
        ("true", "  return { count# };"), ("true", "}"), ("k % 2 = 1", "const emit = defineEmits(['save', 'close']);"), ("true", "const props = defineProps<{ title: string; size?: number }>();"),
    ],
    6: [
        ("true", "import express from 'express';"), ("true", "const router = express.Router();"), ("true", "router.get('/items/:id', getItem#);"),
        ("true", 'router.post("/items", (req, res) => {});'), ("k % 4 = 0", "router.put(`/x/:a/:b`, ctrl.put);"), ("true", "export default router;"),
    ],
    7: [
        ("true", "import { Controller, Get } from '@nestjs/common';"), ("true", "@Controller('users#')"), ("true", "export class UsersController# {"), ("true", "  @Get(':id')"),
        ("true", "  findOne(id: string): string {"), ("true", "    return id;"), ("true", "  }"), ("true", "  @Post()"), ("true", "  create(body: Body) {"), ("true", "  }"), ("true", "}"),
    ],
}
PATHS = ["src/app/(shop)/p#/page.tsx", "src/components/UserButton#.tsx", "src/utils/helper#.ts", "src/hooks/useThing#.ts", "src/cli/run#.ts", "src/vue/V#.ts", "src/api/routes#.ts", "src/api/users#.ts", "src/components/C#.tsx", "src/components/C#.tsx"]


def sources(spark, d: str) -> DataFrame:
    """k, path and text of the derived files."""
    key = F.col("k").cast("string")
    line = lambda cond, text: F.when(F.expr(cond), F.replace(F.lit(text), F.lit("#"), key))
    body = lambda lines: F.concat_ws("\n", F.array(*[line(c, s) for c, s in lines]))
    text = F.when(F.col("m").isin(0, 1, 8, 9), body(REACT))
    for m, lines in FILES.items():
        text = text.when(F.col("m") == m, body(lines))
    path = F.replace(F.element_at(F.array(*map(F.lit, PATHS)), F.col("m") + 1), F.lit("#"), key)
    rows = spread(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k").withColumn("m", (F.col("k") % 10).cast("int"))
    return rows.select("k", "m", path.alias("path"), text.alias("text"))


def joined(items: Column, *fields: str) -> Column:
    """An array as text: elements by comma, fields of a struct by colon."""
    if fields:
        items = F.transform(items, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields]))
    return F.array_join(items, ",")


K = "(SELECT c_custkey AS k, c_custkey % 10 AS m, c_custkey % 10 IN (0, 1, 8, 9) AS r FROM customer)"


def case_list(*items: tuple[str, str]) -> str:
    """SQL for the sorted values whose condition holds, joined by commas."""
    return f"coalesce(array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {c} THEN {v} END' for c, v in items)}], lambda x: x IS NOT NULL)), ','), '')"


def lit(*pairs: tuple[str, str]) -> str:
    return case_list(*[(c, "'" + v.replace("'", "''").replace("#", "' || k || '") + "'") for c, v in pairs])


@query(f"SELECT k, {lit(('r', 'react'), ('r AND k % 3 = 0', '../ui/Card'), ('r AND k % 5 = 0', './side.css'), ('m = 3', 'react'), ('m = 5', 'vue'), ('m = 6', 'express'), ('m = 7', '@nestjs/common'))} AS imports FROM {K}")
def extract_imports(spark, d):
    made, text = scanned(sources(spark, d))
    return made.select("k", joined(X.imports(text)).alias("imports"))


@query(f"SELECT k, {lit(('r AND k % 2 = 0', 'useEffect'), ('r AND k % 2 = 0', 'useState'), ('m = 3', 'useRef'))} AS hooks, {lit(('r AND k % 3 = 0', 'Card'))} AS components FROM {K}")
def extract_hooks_components(spark, d):
    made, text = scanned(sources(spark, d))
    return made.select("k", joined(X.hooks(text)).alias("hooks"), joined(X.components(text)).alias("components"))


FUNCTIONS = lit(("r", "C#"), ("r AND k % 5 < 2", "helper#"), ("m = 2", "formatDate#"), ("m = 3", "useThing#"), ("m = 4", "run#"), ("m = 5", "setup#"), ("m = 7", "create"), ("m = 7", "findOne"))
VARIABLES = lit(("r", "label"), ("r AND k % 5 < 2", "helper#"), ("m = 4", "args"), ("m = 4", "run#"), ("m = 5 AND k % 2 = 1", "emit"), ("m = 5", "props"), ("m = 6", "router"))


@query(f"SELECT k, {FUNCTIONS} AS functions, {VARIABLES} AS variables FROM {K}")
def extract_functions_variables(spark, d):
    made, text = scanned(sources(spark, d))
    return made.select("k", joined(X.functions(text)).alias("functions"), joined(X.variables(text)).alias("variables"))


@query(f"""SELECT k, CASE WHEN r AND k % 4 = 1 THEN 'default' WHEN r AND k % 5 < 2 THEN 'list' WHEN r OR m IN (2, 3, 4, 5, 7) THEN 'named' END AS form,
    CASE WHEN r AND k % 4 <> 1 AND k % 5 < 2 THEN 'C' || k || ',helper' || k END AS named FROM {K}""")
def extract_exports(spark, d):
    made, text = scanned(sources(spark, d))
    e = X.exports(text)
    return made.select("k", e["form"].alias("form"), F.array_join(e["named"], ",").alias("named"))


@query(f"""SELECT k, {lit(('r', 'title:string'), ('r AND k % 2 = 1', 'size:literal-union:true'), ('r AND k % 3 = 0', 'onSelect:function'), ('r AND k % 7 = 0', 'onHover:function:true'), ('r AND k % 5 = 0', 'count:number:true'), ('m = 3', 'a:number'), ('m = 3', 'b:string:true'))} AS props,
    CASE WHEN r AND k % 2 = 1 THEN 'sm,lg' END AS literals FROM {K}""")
def extract_props(spark, d):
    made, text = scanned(sources(spark, d))
    made, p = made.select("k", F.explode(F.array(X.props(text))).alias("p")), F.col("p")
    literals = F.array_join(F.get(F.filter(p, lambda x: x["literals"].isNotNull()), F.lit(0))["literals"], ",")
    return made.select("k", joined(p, "name", "type", "optional").alias("props"), literals.alias("literals"))


@query(f"SELECT k, {lit(('r AND k % 3 = 0', 'onSelect:(id: number) => void'), ('r AND k % 7 = 0', 'onHover:() => void'))} AS emits FROM {K}")
def extract_events(spark, d):
    made, text = scanned(sources(spark, d))
    made = made.select("*", F.explode(F.array(X.props(text))).alias("own"))
    return made.select("k", joined(X.events(text, F.col("own")), "name", "signature").alias("emits"))


@query(f"SELECT k, {lit(('r AND k % 2 = 0', 'open:boolean'), ('r AND k % 6 = 0', 'loading:boolean'))} AS state, {lit(('r', '/home/#'))} AS routes FROM {K}")
def extract_state_routes(spark, d):
    made, text = scanned(sources(spark, d))
    return made.select("k", joined(F.array_sort(X.state(text)), "name", "type").alias("state"), joined(X.jsx_routes(text)).alias("routes"))


LONG = [
    "import {\n  A,\n  B } from 'one'; import two from \"two\";", "// const [gone, setGone] = useState(1); import 'three'", "it's \" one ` quote", "`;",
    "export interface L#Props {", "@@MEMBERS", "  'data-id'?: string; open(x: number): void; last: Map<string, { a: number; b: [1, 2] }>", "}",
    "export type M#Props = { \"aria-label\": string, close(x: (y: number) => void): boolean }", "export const q# = `", "@@LITERAL", "${ useNot() }` , c# = 1, d# = '@@LITERAL'",
    "const pick = <T,>(x: Map<string, T>): T => { return x }", "export function useL#() {", "  const [m, setM] = useState<Map<string, number>>(new Map());",
    "  useA<Foo<Bar<(x: string) => void>>>();", "}", "class K { run(a: (b: string) => void): void { } }",
]
LONG_NAMES = lit(("true", "c#"), ("true", "d#"), ("true", "q#"), ("true", "useL#"))


@query(f"""SELECT k, 'one,two' AS imports, 'useA,useState' AS hooks, 'pick,useL' || k AS functions, {lit(('true', 'q#'), ('true', 'c#'), ('true', 'd#'), ('true', 'pick'))} AS variables, 'list' AS form,
    {LONG_NAMES} AS named, 'm:Map<string, number' AS state, CAST(4 + CASE WHEN k % 200 = 0 THEN 10000 ELSE k % 40 + 1 END AS INTEGER) AS n_props,
    '''data-id'':string,aria-label:string,close:function,last:Map<string, {{ a: number; b: [1, 2] }}>' AS props FROM {K}""")
def extract_long_texts(spark, d):
    """Literals of up to a million characters, interfaces of up to 10000 members, unbalanced quotes, forms within forms."""
    k = F.col("k").cast("string")
    many = lambda every, rare, some: F.when(F.col("k") % every == 0, rare).otherwise(some).cast("int")
    members = F.array_join(F.transform(F.sequence(F.lit(1), many(200, 10000, F.col("k") % 40 + 1)), lambda i: F.concat(F.lit("  m"), i.cast("string"), F.lit(": { a: 'x;y', b(c: number): void };"))), "\n")
    literal = F.repeat(F.lit('SELECT " it // is /* '), many(500, 50000, 150))
    lines = [F.replace(F.replace(F.replace(F.lit(s), F.lit("#"), k), F.lit("@@MEMBERS"), members), F.lit("@@LITERAL"), literal) for s in LONG]
    rows = spread(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")
    made, text = scanned(rows.select("k", F.concat_ws("\n", *lines).alias("text")))
    made = made.select("*", F.explode(F.array(X.props(text))).alias("p"), X.exports(text).alias("e"))
    kept = F.filter("p", lambda x: ~x["name"].rlike(r"^m\d"))
    return made.select(
        "k", joined(X.imports(text)).alias("imports"), joined(X.hooks(text)).alias("hooks"), joined(X.functions(text)).alias("functions"), joined(X.variables(text)).alias("variables"), F.col("e.form").alias("form"),
        joined(F.col("e.named")).alias("named"), joined(X.state(text), "name", "type").alias("state"), F.size("p").alias("n_props"), joined(kept, "name", "type").alias("props"),
    )


# Files with class attributes, and the classes they must give.
CLASS_FORMS = [
    ('<a className="p#  y p#" title="no" />', "p#,y"), ("<a className={on ? 'x-a' : 'x-b'} class='z#'/>", "x-a,x-b,z#"),
    ("const base = 'px-4 py-#'; const v = { primary: 'bg-blue', 'big': `w ${base}` };\n<b className={`flex ${base} ${on ? `a ${v.primary}` : \"c\"} end`} /> <i className={v.big}/>", "flex,px-4,py-#,a,bg-blue,c,end,w"),
    ("<a className={cn('m', on && 'n#', x === 'no' ? 'o' : clsx(p ?? 'q'), { 'never': on }, foo('never'), ['never'])}/>", "m,n#,o,q"),
    ("const a = b; const b = a; const c = a && 'k#'; <a className={c || ('r')} />", "k#,r"), ("<a className={(on || off) && !no && 'yes#'} data={'nope'} /> <b className={x + 'no'}/>", "yes#"),
    ("const s = on ? 'one' : n > 3 ? 'two#' : 'three'\n<a className={s}/> /* <a className='gone' /> */", "one,two#,three"), ("const x = 'className=\"no\"';", ""),
]


@query(f"SELECT k, replace(([{', '.join(chr(39) + v + chr(39) for _, v in CLASS_FORMS)}])[k % {len(CLASS_FORMS)} + 1], '#', CAST(k AS VARCHAR)) AS classes FROM {K}")
def class_expressions(spark, d):
    """Classes in literals, templates, branches, calls and constants, each form dealt to a share of the files."""
    rows = spread(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")
    text = F.replace(F.element_at(F.array(*[F.lit(f) for f, _ in CLASS_FORMS]), (F.col("k") % len(CLASS_FORMS)).cast("int") + 1), F.lit("#"), F.col("k").cast("string"))
    made, src = scanned(rows.select("k", text.alias("text")))
    return made.select("k", joined(Y.classes(src)).alias("classes"))


@query(f"SELECT k, 'a:number:false,b:string:true' AS params FROM {K} WHERE m = 3")
def extract_hook_parameters(spark, d):
    return sources(spark, d).select("k", joined(X.hook_parameters(F.col("text")), "name", "type", "optional").alias("params")).where("params <> ''")


@query(f"""SELECT k, CASE WHEN k % 2 = 1 THEN 'defineEmits,' ELSE '' END || 'defineProps,ref' AS composables, 'count' || k || ':ref<number>,name:ref<string>' AS state,
    CASE WHEN k % 2 = 1 THEN 'save:(e: ''save'') => void,close:(e: ''close'') => void' ELSE '' END AS emits, 'size:number:true,title:string:false' AS props FROM {K} WHERE m = 5""")
def vue_facets(spark, d):
    made, text = scanned(sources(spark, d))
    out = made.where(F.exists(X.imports(text), lambda i: i == "vue"))
    return out.select("k", joined(X.vue_composables(text)).alias("composables"), joined(X.vue_state(text), "name", "type").alias("state"), joined(X.vue_emits(text), "name", "signature").alias("emits"), joined(X.vue_props(text), "name", "type", "optional").alias("props"))


@query("""SELECT k, unnest.method, unnest.path, unnest.handler, unnest.params FROM (SELECT k, unnest(list_filter([
    {'method': 'GET', 'path': '/items/:id', 'handler': 'getItem' || k, 'params': 'id', 'ok': true}, {'method': 'POST', 'path': '/items', 'handler': 'anonymous', 'params': '', 'ok': true},
    {'method': 'PUT', 'path': '/x/:a/:b', 'handler': 'anonymous', 'params': 'a,b', 'ok': k % 4 = 0}], lambda x: x.ok)) AS unnest FROM """ + K + " WHERE m = 6)")
def express_routes(spark, d):
    made, text = scanned(sources(spark, d))
    out = made.where(X.backend(X.imports(text), text) == "express")
    return out.select("k", F.inline(X.express_routes(text))).withColumn("params", F.array_join("params", ","))


@query("""SELECT k, 'UsersController' || k AS controller, 'users' || k AS base_path, unnest.method, unnest.path, unnest.handler FROM (SELECT k, unnest([
    {'method': 'GET', 'path': ':id', 'handler': 'findOne'}, {'method': 'POST', 'path': '', 'handler': 'create'}]) AS unnest FROM """ + K + " WHERE m = 7)")
def nest_routes(spark, d):
    c = X.nest_controller(F.col("text"))
    out = sources(spark, d).select("k", c.alias("c")).where("c is not null").select("k", F.col("c.name").alias("controller"), F.col("c.base_path").alias("base_path"), F.explode("c.routes").alias("r"))
    return out.select("k", "controller", "base_path", "r.method", "r.path", "r.handler")


KIND = "CASE WHEN r THEN 'react:component' WHEN m = 2 THEN 'ts:module' WHEN m = 3 THEN 'react:hook' WHEN m = 4 THEN 'node:cli' WHEN m = 5 THEN 'vue:component' ELSE 'node:api' END"
DESCRIBED = f"""SELECT k, {KIND} AS kind, CASE m WHEN 0 THEN 'page - ' || s WHEN 1 THEN 'UserButton' || k || ' - Interactive button component' WHEN 2 THEN 'helper' || k || ' - Utility module'
    WHEN 3 THEN 'useThing' || k || ' - Custom React hook' WHEN 4 THEN 'run' || k || ' - CLI entry point' WHEN 5 THEN 'V' || k || CASE WHEN k % 2 = 1 THEN ' - Interactive component with internal state' ELSE ' - Stateful component' END
    WHEN 6 THEN 'routes' || k || ' - Presentational component' WHEN 7 THEN 'users' || k || ' - Presentational component' ELSE 'C' || k || ' - ' || s END AS description,
    CASE WHEN r AND k % 2 = 0 THEN 'Has side effects managed by useEffect' || CASE WHEN k % 6 = 0 THEN ';Manages loading/pending UI states' ELSE '' END WHEN m = 3 THEN 'Uses refs for DOM access or mutable values' ELSE '' END AS predictions
    FROM (SELECT *, CASE WHEN k % 2 = 0 AND (k % 3 = 0 OR k % 7 = 0) THEN 'Interactive component with internal state' WHEN k % 2 = 0 THEN 'Stateful component'
        WHEN k % 3 = 0 OR k % 7 = 0 THEN 'Interactive component' ELSE 'Presentational component' END AS s FROM {K})"""


@query(f"SELECT k, kind FROM ({DESCRIBED})")
def kind_case(spark, d):
    made, text = scanned(sources(spark, d))
    return made.select("k", X.kind(text, F.col("path"), X.imports(text), X.hooks(text), X.components(text)).alias("kind"))


def _contracts(spark, d: str) -> DataFrame:
    return X.contracts(sources(spark, d))


@query(f"SELECT k, description FROM ({DESCRIBED})")
def describe_files(spark, d):
    return _contracts(spark, d).select("k", "description")


@query(f"SELECT k, predictions FROM ({DESCRIBED})")
def predictions(spark, d):
    return _contracts(spark, d).select("k", F.array_join("prediction", ";").alias("predictions"))


@query(f"""SELECT k, CASE WHEN r AND k % 4 = 0 THEN 'client' END AS directive, CASE WHEN m = 0 THEN 'page' END AS role, CASE WHEN m = 0 THEN '/p' || k END AS segment FROM {K}""")
def next_facets(spark, d):
    return sources(spark, d).select("k", X.directive(F.col("text")).alias("directive"), X.route_role(F.col("path")).alias("role"), X.segment_path(F.col("path")).alias("segment"))


EMITS = lit(("k % 3 = 0", "onSelect"), ("k % 7 = 0", "onHover")).replace(",', ')", ",', ')")


@query(f"""SELECT k, preset, CASE WHEN preset = 'submit-only' AND e <> '' THEN 'Submit-only contract violated: remove events [' || e || ']'
    WHEN preset = 'nav-only' THEN CASE WHEN e <> '' THEN 'Nav-only contract violated: remove events [' || e || '];' ELSE '' END || 'Nav-only contract expects an onClick navigation handler'
    WHEN preset = 'display-only' THEN concat_ws(';', CASE WHEN e <> '' THEN 'Display-only contract violated: no events permitted, found [' || e || ']' END,
        CASE WHEN k % 2 = 0 THEN 'Display-only contract should minimize internal state, found [open' || CASE WHEN k % 6 = 0 THEN ', loading' ELSE '' END || ']' END) ELSE '' END AS broken
    FROM (SELECT k, r, replace({EMITS}, ',', ', ') AS e FROM {K}) CROSS JOIN (VALUES ('submit-only'), ('nav-only'), ('display-only')) p(preset) WHERE r""")
def preset_violations(spark, d):
    c = _contracts(spark, d).where("m in (0, 1, 8, 9)").select("k", F.transform("emits", lambda e: e["name"]).alias("e"), F.transform("state", lambda s: s["name"]).alias("s"))
    each = F.array(*[F.struct(F.lit(p).alias("preset"), F.array_join(X.preset_violations(p, F.col("e"), F.col("s")), ";").alias("broken")) for p in ("submit-only", "nav-only", "display-only")])
    return c.select("k", F.inline(each))


@query(f"""SELECT k, 'flex' AS type, 'bg-red-500' AS colors, 'p-4' AS spacing, 'lg' AS radius, 'md' AS breakpoints, CAST(4 AS BIGINT) AS n, 'color:red,width' AS inline FROM {K} WHERE r""")
def style_facets(spark, d):
    out = Y.style(sources(spark, d)).where("class_count > 0")
    return out.select("k", "layout.type", F.array_join("visual.colors", ",").alias("colors"), F.array_join("visual.spacing", ",").alias("spacing"), "visual.radius", F.array_join("breakpoints", ",").alias("breakpoints"), F.col("class_count").cast("bigint").alias("n"), joined(F.col("inline_styles"), "name", "value").alias("inline"))


@query(f"""SELECT category, count(*) AS n, count(DISTINCT c) AS n_classes FROM (SELECT unnest([{{'category': 'layout', 'c': 'flex'}}, {{'category': 'spacing', 'c': 'md:p-4'}}, {{'category': 'colors', 'c': 'bg-red-500'}}, {{'category': 'borders', 'c': 'rounded-lg'}}], recursive := true) FROM {K} WHERE r) GROUP BY 1""")
def class_rollup(spark, d):
    made, text = scanned(sources(spark, d))
    each = made.select("k", F.explode(Y.classes(text)).alias("class"))
    return Y.by_category(each, "k").groupBy("category").agg(F.sum("n").alias("n"), F.count_distinct(F.element_at("classes", 1)).alias("n_classes"))


@query(f"SELECT k, 'Card' AS component, CAST(1 AS BIGINT) AS n, CAST(1 AS INTEGER) AS rank FROM {K} WHERE r AND k % 3 = 0")
def ui_components(spark, d):
    return Y.ui_usage(sources(spark, d), "k", r"\.\./ui/\w+", 20)


@query(f"""SELECT k, CASE WHEN r AND k % 4 = 1 THEN 'C' ELSE NULL END AS kept_default, {lit(('r AND k % 3 = 0', 'Card'))} AS components FROM {K}""")
def internal_components(spark, d):
    c = _contracts(spark, d)
    kept = C.without_internal(F.col("components"), F.col("functions"), F.col("exports"))
    return c.select("k", F.when(F.col("exports.form") == "default", "C").alias("kept_default"), joined(kept).alias("components"))


@query(f"""SELECT k, 'uif:' || substr(sha256('{{"components":' || c || ',"functions":' || f || ',"hooks":' || h || ',"variables":' || v || '}}'), 1, 24) AS structure_hash FROM (SELECT k,
    to_json(list_filter(string_split({lit(('r AND k % 3 = 0', 'Card'))}, ','), lambda x: x <> '')) AS c, to_json(list_filter(string_split({FUNCTIONS}, ','), lambda x: x <> '')) AS f,
    to_json(list_filter(string_split({lit(('r AND k % 2 = 0', 'useEffect'), ('r AND k % 2 = 0', 'useState'), ('m = 3', 'useRef'), ('m = 5 AND k % 2 = 1', 'defineEmits'), ('m = 5', 'defineProps'), ('m = 5', 'ref'))}, ','), lambda x: x <> '')) AS h, to_json(list_filter(string_split({VARIABLES}, ','), lambda x: x <> '')) AS v FROM {K})""")
def structure_hash(spark, d):
    return C.with_hashes(_contracts(spark, d)).select("k", "structure_hash")


@query(f"SELECT folder, count(*) AS n, label FROM (SELECT CASE WHEN m = 0 THEN 'src/app/(shop)/p' || k WHEN r THEN 'src/components' WHEN m = 2 THEN 'src/utils' WHEN m = 3 THEN 'src/hooks' WHEN m = 4 THEN 'src/cli' WHEN m = 5 THEN 'src/vue' ELSE 'src/api' END AS folder, CASE WHEN m = 0 THEN 'Next.js App' END AS label FROM {K}) GROUP BY 1, 3")
def root_labels(spark, d):
    each = sources(spark, d).select(S.folder(F.col("path")).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    n = each.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("file").isin("page.tsx", "layout.tsx"), F.col("file"))).alias("files"))
    return n.select("folder", "n", root_label(F.col("folder"), F.col("files")).alias("label"))


@query(f"""SELECT 'src/' || CASE WHEN m % 2 = 0 THEN 'even' ELSE 'odd' END AS folder, CAST(row_number() OVER (PARTITION BY m % 2 ORDER BY k) AS INTEGER) AS place,
    '{{"$schema":"{sinks.SCHEMA_URL}","position":"' || row_number() OVER (PARTITION BY m % 2 ORDER BY k) || '/' || count(*) OVER (PARTITION BY m % 2) || '","entry_id":' || k || '}}' AS line FROM {K}""")
def format_ndjson(spark, d):
    rows = sources(spark, d).select(F.concat(F.lit("src/"), F.when(F.col("m") % 2 == 0, "even").otherwise("odd")).alias("folder"), F.col("k").alias("entry_id"))
    return sinks.format_bundles(rows, "ndjson").withColumn("place", F.col("place").cast("int"))
