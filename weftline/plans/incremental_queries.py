"""Queries of incremental rebuilds, canonical hashes, the compact form and collated order over files derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import engine
from weftline.functions import compact
from weftline.functions.canonical import canonical_json, collated
from weftline.operators import contract as C
from weftline.operators import extract as X
from weftline.operators import report as R
from weftline.operators import scan as S
from weftline.operators.lexer import scanned
from weftline.plans.registry import query, spread, t
from weftline.sources import files, sinks
from weftline.storage import Scratch
from weftline.streaming.incremental import Incremental


def _file(path, uses, n: int) -> list:
    text = F.concat(F.lit("export function F() { return <div>"), uses, F.lit("</div> }\n"))
    return [path.alias("path"), F.when(uses.isNotNull(), text).alias("text"), F.lit(n).alias("ts")]


def rebuilt(spark, d: str) -> Incremental:
    """Three batches over files for suppliers, nations and regions: half of the nations first name a region that is not there,
    then are mended as the regions come, then every third supplier goes."""
    s, n, r = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "region")
    tag = lambda letter, key: F.concat(F.lit(f"<{letter}"), F.col(key).cast("string"), F.lit(" />"))
    path = lambda letter, key: F.concat(F.lit(f"src/{letter}"), F.col(key).cast("string"), F.lit(".tsx"))
    wrong = F.when(F.col("n_nationkey") % 2 == 0, tag("Q", "n_regionkey")).otherwise(tag("R", "n_regionkey"))
    batches = [
        s.select(*_file(path("S", "s_suppkey"), tag("N", "s_nationkey"), 0)).union(n.select(*_file(path("N", "n_nationkey"), wrong, 0))),
        n.where("n_nationkey % 2 = 0").select(*_file(path("N", "n_nationkey"), tag("R", "n_regionkey"), 1)).union(r.select(*_file(path("R", "r_regionkey"), F.lit("-"), 1))),
        s.where("s_suppkey % 3 = 0").select(*_file(path("S", "s_suppkey"), F.lit(None).cast("string"), 2)),
    ]
    out = Incremental(spark, Scratch(spark, "rebuilt").base, strict=True)
    for epoch, batch in enumerate(batches):
        out.apply(batch, epoch)
    return out


@query("""WITH kept AS (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE s_suppkey % 3 <> 0),
        roots AS (SELECT 'src/S' || s || '.tsx' AS root, n FROM kept UNION ALL SELECT 'src/N' || n_nationkey || '.tsx', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT n FROM kept))
    SELECT root, root AS id, CAST(0 AS INTEGER) AS level FROM roots
    UNION ALL SELECT root, 'src/N' || n || '.tsx', 1 FROM roots WHERE root LIKE 'src/S%'
    UNION ALL SELECT root, 'src/R' || n_regionkey || '.tsx', CASE WHEN root LIKE 'src/S%' THEN 2 ELSE 1 END FROM roots JOIN nation ON n_nationkey = n""")
def incremental_rebuild(spark, d):
    """The bundles after three batches, which a whole run over the files that are left would give."""
    return rebuilt(spark, d).table("members").select("root", "id", "level")


_SERVER = "import express from 'express';\nconst app = express();\n"


@query("""SELECT o_orderkey AS id, 'uif:' || substr(sha256('{"backend":{"framework":"express","languageSpecific":{"decorators":["@app.get","@app.post"]},"routes":[{"handler":"a' || o_custkey || '","method":"GET","params":["id"],"path":"/a/:id"},{"handler":"b","method":"POST","params":[],"path":"/b"}]},'
    || '"schemaVersion":"0.4","signature":{"apiSignature":{"parameters":{"id":"string"}},"emits":{},"props":{}},"structure":{"components":[],"functions":[],"hooks":[],"variables":["app"]}}'), 1, 24) AS semantic_hash FROM orders""")
def semantic_hash(spark, d):
    """Contracts of server files; half of them state their two routes in the other order, which changes nothing."""
    get, post = F.concat(F.lit("app.get('/a/:id', a"), F.col("o_custkey").cast("string"), F.lit(");\n")), F.lit("app.post('/b', b);\n")
    text = F.concat(F.lit(_SERVER), F.when(F.col("o_orderkey") % 2 == 0, F.concat(get, post)).otherwise(F.concat(post, get)))
    rows = spread(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(F.col("o_orderkey").alias("id"), F.lit("src/api.ts").alias("path"), text.alias("text"))
    return C.with_hashes(X.contracts(rows)).select("id", "semantic_hash")


@query("""SELECT p_partkey AS id, '{"a":{"k1":["x","y' || p_partkey || '"],"k2":null_free},"n":' || p_size || ',"z":[{"b":true,"c":"q\\"' || p_partkey || '"}]}' AS json FROM part""".replace("null_free", "[]"))
def canonical_nested(spark, d):
    """Canonical JSON of maps within structs and structs within arrays, whose keys and strings come in any order."""
    key = F.col("p_partkey").cast("string")
    strings = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("x"), F.concat(F.lit("y"), key))).otherwise(F.array(F.concat(F.lit("y"), key), F.lit("x")))
    none = F.array().cast("array<string>")
    maps = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("k1"), strings, F.lit("k2"), none, F.lit("k3"), F.lit(None).cast("array<string>"))).otherwise(F.create_map(F.lit("k2"), none, F.lit("k1"), strings))
    inner = F.struct(F.concat(F.lit('q"'), key).alias("c"), F.lit(True).alias("b"), F.lit(None).cast("string").alias("none"))
    rows: DataFrame = t(spark, d, "part").select("p_partkey", F.struct(F.array(inner).alias("z"), F.col("p_size").alias("n"), maps.alias("a")).alias("v"))
    return rows.select(F.col("p_partkey").alias("id"), canonical_json(F.col("v"), rows.schema["v"].dataType).alias("json"))


_NAMES = ["a", "B", "é", "Z", "b", "ä", "A", "z"]
_RANK = {n: k for k, n in enumerate(["a", "A", "ä", "b", "B", "é", "z", "Z"])}


@query(f"SELECT p_size AS size, string_agg(n, ',' ORDER BY r) AS collated, string_agg(n, ',' ORDER BY n) AS binary_order FROM (SELECT DISTINCT p_size, ([{', '.join(chr(39) + n + chr(39) for n in _NAMES)}])[p_partkey % 8 + 1] AS n, ([{', '.join(str(_RANK[n]) for n in _NAMES)}])[p_partkey % 8 + 1] AS r FROM part) GROUP BY 1")
def stable_order(spark, d):
    """Names in the two orders: collated for ids, binary for arrays."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 8).cast("int") + 1)
    rows = t(spark, d, "part").select(F.col("p_size").alias("size"), name.alias("n")).distinct()
    held = rows.groupBy("size").agg(F.collect_list("n").alias("names"))
    keyed = F.array_sort(F.transform("names", lambda n: F.struct(collated(n).alias("c"), n.alias("n"))))
    return held.select("size", F.array_join(F.transform(keyed, lambda k: k["n"]), ",").alias("collated"), F.array_join(F.array_sort("names"), ",").alias("binary_order"))


@query("""SELECT o_custkey AS folder, CAST(row_number() OVER w AS INTEGER) AS place, '$schema: "https://example.org/schemas/context/v0.1.json"' AS head, 'position: ' || row_number() OVER w || '/' || count(*) OVER (PARTITION BY o_custkey) || chr(10) ||
    'entry_id: ' || o_orderkey || chr(10) || 'lines[' || n || ']{part,flag,mode}:' || chr(10) || rows || chr(10) || 'flags[' || n || ']: ' || flags AS body
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n, string_agg('  ' || l_partkey || ',' || l_returnflag || ',"' || l_linestatus || ':"', chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS rows, string_agg(CASE WHEN l_linenumber = 1 THEN '"true"' ELSE l_returnflag END, ',' ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS flags
        FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def format_toon(spark, d):
    """Orders with their lines in the compact form, read back and written again."""
    line = F.struct("l_linenumber", F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.concat("l_linestatus", F.lit(":")).alias("mode")).alias("x"), F.when(F.col("l_linenumber") == 1, "true").otherwise(F.col("l_returnflag")).alias("f"))
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("held"))
    held = lambda c: F.transform("held", lambda h: h[c])
    bundles = t(spark, d, "orders").join(lines, "o_orderkey").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("entry_id"), held("x").alias("lines"), held("f").alias("flags"))
    out = sinks.format_bundles(bundles, "toon").withColumn("place", F.col("place").cast("int"))
    read = compact.decode(F.col("line"), "`$schema` string, position string, entry_id bigint, lines array<struct<part:bigint,flag:string,mode:string>>, flags array<string>")
    again = out.select("folder", "place", read.alias("v"))
    text = compact.encode(F.col("v"), again.schema["v"].dataType)
    return again.select("folder", "place", F.substring_index(text, "\n", 1).alias("head"), F.regexp_replace(text, r"^[^\n]*\n", "").alias("body"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'express' ELSE 'nest' END AS framework, CASE WHEN c_custkey % 2 = 0 THEN 'id:number,q:Query<' || c_custkey || '>,req:Request,res:any' ELSE 'body:Body' || c_custkey || ',id:string' END AS parameters,
    CASE WHEN c_custkey % 2 = 0 THEN 'Promise<Map<string, Item>>' ELSE 'User' || c_custkey END AS return_type, CASE WHEN c_custkey % 2 = 0 THEN '@router.get,@router.post,@router.put' ELSE '@Controller,@Get,@Param,@Post' END AS marks FROM customer""")
def contract_api(spark, d):
    """The API signature of server files: routes meet their handlers, declared before or after, as functions, arrows or methods."""
    key = F.col("c_custkey").cast("string")
    express = """import express from 'express';\nconst router = express.Router();\nfunction getItem(id: number, q: Query<#>): Promise<Map<string, Item>> { return find(id) }
router.get('/items/:id', getItem);\nrouter.post('/items', save);\nrouter.put('/x', (req, res) => {});\nconst save = async (req: Request, res) => { };\nconst other = (unused: string): void => {};\n"""
    nest = """import { Controller, Get } from '@nestjs/common';\n@Controller('users')\nexport class Users {\n  @Get(':id')\n  async findOne(@Param('id') id: string): User# {\n    return one(id);\n  }\n  @Post()
  create(body: Body#) {\n  }\n  private helper(x: number): void {\n  }\n}\n"""
    text = F.replace(F.when(F.col("c_custkey") % 2 == 0, express).otherwise(nest), F.lit("#"), key)
    found = X.contracts(spread(t(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("k"), F.lit("src/api.ts").alias("path"), text.alias("text")))
    api = F.col("api_signature")
    return found.select(
        "k", "framework", F.array_join(F.transform(api["parameters"], lambda p: F.concat_ws(":", p["name"], p["type"])), ",").alias("parameters"), api["return_type"].alias("return_type"),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce("decorators", "annotations"))), ",").alias("marks"),
    )


@query("""WITH f AS (SELECT p_partkey AS k, 'src/f' || p_partkey || '.ts' AS path FROM part)
    SELECT path, CAST(CASE WHEN k % 4 = 0 THEN 2 WHEN k % 4 = 3 THEN 0 ELSE 1 END AS INTEGER) AS n_masked, 'const apiKey = ' || CASE WHEN k % 4 = 3 THEN '"SECRET' || k || 'abcdefghij"' ELSE '"PRIVATE_DATA"' END || ', other = "SECRET' || k || 'zz"' || chr(10)
        || CASE WHEN k % 4 = 0 THEN 'url = "mysql://u:PRIVATE_DATA@h/db"' ELSE 'url = "mysql://u:pw' || k || '@h/db"' END AS masked FROM f""")
def mask_by_report(spark, d):
    """A report whose files are named in full, below its own root, or below the present one; every fourth file has no match, every fourth two."""
    k = F.col("p_partkey")
    parts = spread(t(spark, d, "part").select("p_partkey"), "p_partkey")
    key = k.cast("string")
    path = F.concat(F.lit("src/f"), key, F.lit(".ts"))
    text = F.concat(F.lit('const apiKey = "SECRET'), key, F.lit('abcdefghij", other = "SECRET'), key, F.lit('zz"\nurl = "mysql://u:pw'), key, F.lit('@h/db"'))
    rows_of = parts.select(path.alias("path"), text.alias("text"))
    name = F.when(k % 4 == 0, F.concat(F.lit("/old/./"), path)).when(k % 4 == 1, F.concat(F.lit("./"), path)).when(k % 4 == 2, F.concat(F.lit("/new/SRC/../"), path))
    hit = lambda line, column, kind, snippet: F.struct(F.lit(line).cast("long").alias("line"), F.lit(column).cast("long").alias("column"), F.lit(kind).alias("type"), snippet.alias("snippet"))
    first = hit(1, 7, "API Key", F.concat(F.lit('apiKey = "SECRET'), key, F.lit('abcdefghij"')))
    second = hit(2, 8, "Database URL with Credentials", F.concat(F.lit("mysql://u:pw"), key, F.lit("@h/db")))
    rows = parts.where(k % 4 != 3).select(F.when(k % 4 == 0, F.concat(F.lit("/old/./"), path)).otherwise(name).alias("file"), F.explode(F.when(k % 4 == 0, F.array(first, second)).otherwise(F.array(first))).alias("m"))
    report = rows.select("file", "m.*").withColumn("file", F.when(F.col("file").startswith("/old"), F.replace("file", F.lit("/old/"), F.lit(""))).otherwise(F.col("file")))
    return R.mask_by_report(rows_of, report, "/old", "/new").select("path", "n_masked", "masked")


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
    used AS (SELECT DISTINCT n FROM s), roots AS (SELECT 'src/S' || s.k || '.tsx' AS entry_id, n.k AS n, n.r AS r, s.k AS s FROM s JOIN n ON n.k = s.n UNION ALL SELECT 'src/N' || k || '.tsx', k, r, NULL FROM n WHERE k NOT IN (SELECT n FROM used))
    SELECT entry_id, 'src/N' || n || '.tsx,src/R' || r || '.tsx' || CASE WHEN s IS NULL THEN '' ELSE ',src/S' || s || '.tsx' END AS nodes,
        'src/N' || n || '.tsx>src/R' || r || '.tsx' || CASE WHEN s IS NULL THEN '' ELSE ',src/S' || s || '.tsx>src/N' || n || '.tsx' END AS edges,
        CASE WHEN s IS NULL THEN 'Gone' || n || ':not found:src/N' || n || '.tsx' ELSE 'Gone' || n || ':not found:src/N' || n || '.tsx' END AS missing,
        '/** @uif N' || n || ' */' AS header, 'const token = "PRIVATE_DATA";' AS secret_line, CAST(1 AS BIGINT) AS n_headers FROM roots""")
def bundle_rows(spark, d):
    """Whole bundles over suppliers, nations and regions: contracts, edges, missing names, masked code and headers, read back from JSON lines."""
    s, n, r = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "region")
    tag = lambda letter, key: F.concat(F.lit(f"<{letter}"), F.col(key).cast("string"), F.lit(" />"))
    secret = F.lit('const token = "abcdefghijklmnopqrstuvwx";\n')

    def made(df, letter, key, uses, header):
        text = F.concat(header, secret, F.lit("export function F() { return <div>"), uses, F.lit("</div> }\n"))
        return df.select(F.concat(F.lit(f"src/{letter}"), F.col(key).cast("string"), F.lit(".tsx")).alias("path"), text.alias("text"))

    head = F.concat(F.lit("/** @uif N"), F.col("n_nationkey").cast("string"), F.lit(" */\n"))
    nations = made(n, "N", "n_nationkey", F.concat(tag("R", "n_regionkey"), tag("Gone", "n_nationkey")), head)
    sources = made(s, "S", "s_suppkey", tag("N", "s_nationkey"), F.lit("")).union(nations).union(made(r, "R", "r_regionkey", F.lit("-"), F.lit("")))
    sources = Scratch(spark, "sources").put(sources)
    rows = engine.context_of(sources).bundle_rows(sources, 2, "full", hash_lock=True)
    kind = rows.schema["bundle"].dataType
    back = rows.select("entry_id", F.from_json(F.to_json("bundle"), kind).alias("b"))
    nation = F.get(F.filter("b.graph.nodes", lambda x: x["codeHeader"].isNotNull()), F.lit(0))
    return back.select(
        "entry_id", F.array_join(F.transform("b.graph.nodes", lambda x: x["entryId"]), ",").alias("nodes"), F.array_join(F.transform("b.graph.edges", lambda e: F.array_join(e, ">")), ",").alias("edges"),
        F.array_join(F.transform("b.meta.missing", lambda m: F.concat_ws(":", m["name"], m["reason"], m["referencedBy"])), ",").alias("missing"), nation["codeHeader"].alias("header"),
        F.element_at(F.split(nation["code"], "\n"), 2).alias("secret_line"), F.size(F.filter("b.graph.nodes", lambda x: x["codeHeader"].isNotNull())).cast("long").alias("n_headers"),
    )


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'it''s #' || c_custkey WHEN 1 THEN NULL ELSE NULL END AS title, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS DOUBLE) + 0.5 END AS priority, CASE WHEN c_custkey % 4 = 0 THEN true END AS live,
    CASE WHEN c_custkey % 4 = 0 THEN '[object]' END AS open_graph, CASE WHEN c_custkey % 4 = 1 THEN true END AS has_metadata, c_custkey % 4 = 2 AS dynamic FROM customer""")
def metadata_values(spark, d):
    """Values of static metadata as VARIANT: literals by their type, nested ones by kind, an expression as a mark, none."""
    k = F.col("c_custkey")
    key = k.cast("string")
    whole = F.concat(F.lit("export const metadata: Metadata = {\n  title: 'it\\'s #"), key, F.lit("', // { title: 'no' }\n  \"priority\": "), key, F.lit(".5, live: true, gone: null,\n  openGraph: { title: 'x, y' }, list: [1, 2],\n};"))
    text = F.when(k % 4 == 0, whole).when(k % 4 == 1, "export const metadata = make();").when(k % 4 == 2, "export async function generateMetadata() { return {} }").otherwise("const metadata = { title: 'own' };")
    found = spread(t(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("k"), text.alias("text"))
    made, source = scanned(found)
    found = made.select("k", F.explode(F.array(X.metadata(source))).alias("m")).select("k", "m.dynamic", F.explode(F.array(F.parse_json("m.static"))).alias("v"))
    get = lambda path, kind, name: F.variant_get("v", f"$.{path}", kind).alias(name)
    return found.select("k", get("title", "string", "title"), get("priority", "double", "priority"), get("live", "boolean", "live"), get("openGraph", "string", "open_graph"), get("_hasMetadata", "boolean", "has_metadata"), "dynamic")


@query("""SELECT 'n' || n_nationkey AS path, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE '0.3' END AS version, 'src/S' || s_suppkey || '.tsx' AS key, 'S' || s_suppkey AS entry_id, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' END AS dependencies, CASE WHEN s_suppkey % 3 = 0 THEN 'h' || s_suppkey END AS semantic_hash
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND n_nationkey % 5 <> 4""")
def manifest_rows(spark, d):
    """Stored manifests, one for each nation with its suppliers as components, whose fields come and go; every fifth is no JSON."""
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    key = F.col("s_suppkey").cast("string")
    node = F.concat(F.lit('{"entryId":"S'), key, F.lit('"'), F.when(F.col("s_suppkey") % 2 == 0, ',"dependencies":["a","b"]').otherwise(',"dependencies":"none"'), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(',"semanticHash":"h'), key, F.lit('"'))).otherwise(""), F.lit("}"))
    held = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.collect_list(F.concat(F.lit('"src/S'), key, F.lit('.tsx":'), node)), ",").alias("c"))
    rows = n.join(held, "n_nationkey", "left").withColumn("c", F.coalesce("c", F.lit("")))
    text = F.when(F.col("n_nationkey") % 5 == 4, "no { json").otherwise(F.concat(F.lit('{"version":"0.3","components":{'), F.col("c"), F.lit("}}")))
    out = files.component_fields(files.manifest_rows(rows.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), text.alias("text"))))
    return out.select("path", "version", "key", "entry_id", F.array_join("dependencies", ",").alias("dependencies"), "semantic_hash")


@query("""WITH b AS (SELECT coalesce(source, '-') || '/' || coalesce(lang, '-') AS folder, length(coalesce(text, '')) AS a, length(coalesce(text, '')) + CASE WHEN doc_id % 2 = 0 THEN 40 ELSE 0 END AS z FROM documents),
        n AS (SELECT folder, sum(a) + count(*) + 1 AS a, sum(z) + count(*) + 1 AS z FROM b GROUP BY 1),
        g AS (SELECT folder, CAST(ceil(a / 4.0) AS BIGINT) AS gpt_old, CAST(ceil(z / 4.0) AS BIGINT) AS gpt_new, CAST(ceil(a / 4.5) AS BIGINT) AS claude_old, CAST(ceil(z / 4.5) AS BIGINT) AS claude_new FROM n)
    SELECT folder, gpt_old, gpt_new, gpt_new - gpt_old AS gpt_delta, claude_old, claude_new, claude_new - claude_old AS claude_delta, round(100.0 * (gpt_new - gpt_old) / gpt_old, 2) AS percent FROM g""")
def token_delta(spark, d):
    """Tokens of each folder before and after every second text grew by forty characters."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))).alias("folder")
    text = F.coalesce("text", F.lit(""))
    docs = t(spark, d, "documents")
    grown = F.when(F.col("doc_id") % 2 == 0, F.concat(text, F.repeat(F.lit("x"), F.lit(40)))).otherwise(text)
    return S.token_delta(docs.select(folder, text.alias("text")), docs.select(folder, grown.alias("text")))
