"""Queries over the statistics of a run, the index over folders, component libraries and presets; SQL says each from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import extract as X
from weftline.operators import libraries as L
from weftline.operators import summary as S
from weftline.plans.registry import EDGES, NODES, fk_graph, query, spread, t
from weftline.plans.source_queries import case_list, joined

_STATS = f"""n AS (SELECT count(*) AS c, count(*) FILTER (id NOT IN (SELECT dst FROM {EDGES})) AS r, count(*) FILTER (id NOT IN (SELECT src FROM {EDGES})) AS l FROM {NODES}),
    b AS (SELECT count(*) AS b, CAST(sum(x + 1) AS BIGINT) AS nodes, CAST(sum(x) AS BIGINT) AS edges, CAST(sum(m) AS BIGINT) AS missing FROM (SELECT count(*) AS x, count(*) FILTER (l_returnflag = 'R') AS m FROM lineitem GROUP BY l_orderkey)),
    z AS (SELECT CAST(sum(length(html) + 1) - 1 AS BIGINT) AS o FROM pages), s AS (SELECT CAST(sum(length(text)) AS BIGINT) AS s FROM documents),
    k AS (SELECT *, CAST(ceil(o / 4.0) AS BIGINT) AS g, CAST(ceil(o / 4.5) AS BIGINT) AS h, CAST(ceil(o / 4.0) + ceil(s / 4.0) AS BIGINT) AS fg, CAST(ceil(o / 4.5) + ceil(s / 4.5) AS BIGINT) AS fh FROM n, b, z, s)"""


def _stats(spark, d):
    nodes, edges = fk_graph(spark, d)
    bundles = t(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) + 1).alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("l_returnflag") == "R").alias("n_missing"))
    return S.run_stats(nodes, edges, bundles, t(spark, d, "pages").select(F.col("html").alias("line")), t(spark, d, "documents"))


@query(f"""WITH {_STATS} SELECT c AS total_components, r AS root_components, l AS leaf_components, b AS bundles_generated, nodes AS total_nodes, edges AS total_edges, missing AS missing_dependencies, g AS tokens_gpt4, h AS tokens_claude,
    CAST(ceil(g * 0.6) AS BIGINT) AS none_gpt4, CAST(ceil(h * 0.6) AS BIGINT) AS none_claude, g AS header_gpt4, h AS header_claude, fg AS full_gpt4, fh AS full_claude,
    CAST(CAST(floor((fg - g) * 100.0 / fg + 0.5) AS BIGINT) AS VARCHAR) AS savings_gpt4, CAST(CAST(floor((fh - h) * 100.0 / fh + 0.5) AS BIGINT) AS VARCHAR) AS savings_claude FROM k""")
def run_stats(spark, d):
    flat = [F.col(f"mode_estimates.{mode}.{m}").alias(f"{mode}_{m}") for mode in ("none", "header", "full") for m in ("gpt4", "claude")]
    return _stats(spark, d).select("*", *flat).drop("mode_estimates")


@query(f"""WITH {_STATS}, v AS (SELECT 'header' AS run, g, h, CAST(ceil(g * 2.05) AS BIGINT) AS sg, CAST(ceil(h * 2.05) AS BIGINT) AS sh, CAST(ceil(g / 0.30::DECIMAL(3,2)) AS BIGINT) AS rg, CAST(ceil(h / 0.30::DECIMAL(3,2)) AS BIGINT) AS rh FROM k
    UNION ALL SELECT 'full', CAST(ceil(g * 0.75) AS BIGINT), CAST(ceil(h * 0.75) AS BIGINT), CAST(ceil(g * 0.85) AS BIGINT), CAST(ceil(h * 0.85) AS BIGINT), CAST(ceil(s / 4.0) AS BIGINT), CAST(ceil(s / 4.5) AS BIGINT) FROM k)
    SELECT run, place, mode, gpt4, claude, CAST(CAST(floor((rg - gpt4) * 100.0 / rg + 0.5) AS BIGINT) AS VARCHAR) AS savings FROM (SELECT run, rg, 1 AS place, 'source' AS mode, rg AS gpt4, rh AS claude FROM v
    UNION ALL SELECT run, rg, 2, 'header', g, h FROM v UNION ALL SELECT run, rg, 3, 'header+style', sg, sh FROM v)""")
def mode_table(spark, d):
    """What a run in header mode and one in full mode say about the other modes."""
    chars = t(spark, d, "documents").agg(F.sum(F.char_length("text").cast("bigint")).alias("chars"))
    stats = _stats(spark, d).join(F.broadcast(chars))  # one row each
    return S.mode_table(stats, F.col("chars")).withColumn("run", F.lit("header")).union(S.mode_table(stats, F.col("chars"), "full").withColumn("run", F.lit("full")))


_LOST = "(SELECT 'order:' || l_orderkey AS root, 'Lost' || l_partkey % 37 AS name FROM lineitem WHERE l_returnflag = 'R')"


@query(f"""SELECT CAST(row_number() OVER (ORDER BY f, name) AS INTEGER) AS place, name, n_bundles, greatest(a - 10, 0) AS more FROM (SELECT *, count(*) OVER () AS a FROM
    (SELECT name, min(root) AS f, count(DISTINCT root) AS n_bundles FROM {_LOST} GROUP BY 1)) QUALIFY row_number() OVER (ORDER BY f, name) <= 10""")
def missing_names(spark, d):
    lost = t(spark, d, "lineitem").where("l_returnflag = 'R'")
    return S.missing_names(lost.select(F.concat(F.lit("order:"), F.col("l_orderkey")).alias("root"), F.concat(F.lit("Lost"), F.col("l_partkey") % 37).alias("name")))


_PLACED = """(SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 20 = 0 THEN '.' WHEN doc_id % 20 < 5 THEN 'src' WHEN doc_id % 20 < 9 THEN 'src/app/p' || doc_id % 40 ELSE 'apps/' || coalesce(source, '-') END AS folder FROM documents)"""
_FOLDERS = f"""(SELECT folder, CASE WHEN folder = '.' THEN 'context.json' ELSE folder || '/context.json' END AS context_file, count(*) AS bundles, CAST(ceil((sum(length(text)) + count(*) - 1) / 4.0) AS BIGINT) AS token_estimate,
    CASE WHEN folder = '.' THEN 'Project Root' WHEN folder LIKE 'src/app/%' AND count(*) FILTER (doc_id % 3 = 0) > 0 THEN 'Next.js App' WHEN folder = 'src' THEN 'Main Source' WHEN folder LIKE 'apps/%' THEN 'App: ' || string_split(folder, '/')[2] END AS root_label FROM {_PLACED} GROUP BY folder)"""


def _folders(spark, d):
    k = F.col("doc_id")
    place = F.when(k % 20 == 0, ".").when(k % 20 < 5, "src").when(k % 20 < 9, F.concat(F.lit("src/app/p"), k % 40)).otherwise(F.concat(F.lit("apps/"), F.coalesce("source", F.lit("-"))))
    rows = t(spark, d, "documents").select("doc_id", place.alias("folder"), F.coalesce("text", F.lit("")).alias("line"))
    name = F.concat("folder", F.when(k % 3 == 0, "/page.tsx").otherwise(F.concat(F.lit("/C"), k, F.lit(".tsx"))))
    return S.folder_index(rows, rows.select("folder", name.alias("entry_id")))


@query(f"SELECT folder, context_file, bundles, root_label IS NOT NULL AS is_root, root_label, token_estimate FROM {_FOLDERS}")
def folder_index(spark, d):
    return _folders(spark, d)


@query(f"SELECT (SELECT count(*) FROM documents) AS total_components, CAST(sum(bundles) AS BIGINT) AS total_bundles, count(*) AS total_folders, CAST(sum(token_estimate) AS BIGINT) AS total_token_estimate FROM {_FOLDERS}")
def index_totals(spark, d):
    return S.index_totals(_folders(spark, d), t(spark, d, "documents"))


# (condition on the key k, line) of files that use component libraries.
_UI = [
    ("k % 3 = 0", "import Btn from '@mui/material/Button';"), ("k % 3 = 0", "import { Box, Card as Panel } from '@mui/material';"), ("k % 6 = 0", "import { ThemeProvider } from '@mui/material/styles';"),
    ("k % 3 = 1", "import { Button as B, Badge } from '@/components/ui/button';"), ("k % 4 = 1", "import { Sun } from 'lucide-react';"),
    ("k % 3 = 2", "import * as Dialog from '@radix-ui/react-dialog';"), ("k % 6 = 2", "import { Select, SelectTrigger } from '@radix-ui/react-select';"),
    ("true", "// <Box/> <B variant=\"ghost\"/>"), ("true", "export const A = () => <main className=\"p-1\">"), ("k % 3 = 0", "<Btn label='<Box/>' onClick={() => ({ a: '}' })}/> <Panel/><Panel/>"),
    ("k % 9 = 0", "<Box sx={{ p: 1 }} p={2}>x</Box>"), ("k % 3 = 1", "<B variant=\"ghost\" size=\"sm\"/>"), ("k % 5 = 0", "<B variant=\"odd\" size=\"icon\"/>"), ("k % 6 = 1", "<Badge variant='outline'/>"),
    ("k % 3 = 2", "<Dialog.Root modal><Dialog.Portal/>"), ("k % 6 = 2", "<Dialog.Content open={o}/><Select defaultValue=\"a\" asChild/>"), ("k % 3 = 2", "</Dialog.Root>"), ("true", "</main>;"),
]


@query(f"""SELECT c_custkey AS k, CASE WHEN k % 3 <> 0 THEN '' WHEN k % 9 = 0 THEN 'Card,Box,Button' ELSE 'Card,Button,Box' END AS material, {case_list(('k % 3 = 0', "'@mui/material'"), ('k % 3 = 0', "'@mui/material/Button'"), ('k % 6 = 0', "'@mui/material/styles'"))} AS packages,
    k % 6 = 0 AS theme, k % 9 = 0 AS sx, k % 9 = 0 AS system_props, CASE WHEN k % 3 <> 1 THEN '' WHEN k % 6 = 1 AND k % 5 <> 0 THEN 'Badge,Button' ELSE 'Button,Badge' END AS kit,
    CASE WHEN k % 3 = 1 THEN CASE WHEN k % 6 = 1 THEN 'badge:outline,' ELSE '' END || 'button:ghost' ELSE '' END AS variants, CASE WHEN k % 3 = 1 THEN CASE WHEN k % 5 = 0 THEN 'icon,' ELSE '' END || 'sm' ELSE '' END AS sizes,
    k % 4 = 1 AS icons, CASE WHEN k % 3 = 1 THEN 'low' END AS density, CASE WHEN k % 3 <> 2 THEN '' WHEN k % 6 = 2 THEN 'react-dialog:Dialog.*,react-select:Select SelectTrigger' ELSE 'react-dialog:Dialog.*' END AS primitives,
    CASE WHEN k % 6 = 2 THEN 'DialogContent' ELSE '' END AS controlled, CASE WHEN k % 6 = 2 THEN 'Select' ELSE '' END AS uncontrolled, CAST(k % 3 = 2 AS INTEGER) AS portals, CAST(k % 6 = 2 AS INTEGER) AS as_child, k % 3 = 2 AS modal,
    CASE WHEN k % 3 = 2 THEN 'simple' END AS depth FROM (SELECT c_custkey, c_custkey AS k FROM customer)""")
def ui_libraries(spark, d):
    """A file for each customer, its imports and tags by the key."""
    text = F.concat_ws("\n", F.array(*[F.when(F.expr(c), line) for c, line in _UI]))
    made = L.ui_libraries(spread(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k").withColumn("text", text))
    m, u, p = F.col("material"), F.col("kit"), F.col("primitives")
    pair = lambda name, items, sep: joined(F.transform(items, lambda x: F.concat(x[name], F.lit(":"), F.array_join(x[sep], " "))))
    return made.select(
        "k", joined(m["components"]).alias("material"), joined(m["packages"]).alias("packages"), m["theme"].alias("theme"), m["sx"].alias("sx"), m["system_props"].alias("system_props"), joined(u["components"]).alias("kit"),
        pair("type", u["variants"], "values").alias("variants"), joined(u["sizes"]).alias("sizes"), u["icons"].alias("icons"), u["density"].alias("density"), pair("package", p["primitives"], "components").alias("primitives"),
        joined(p["controlled"]).alias("controlled"), joined(p["uncontrolled"]).alias("uncontrolled"), p["portals"].alias("portals"), p["as_child"].alias("as_child"), p["modal"].alias("modal"), p["depth"].alias("depth"),
    )


@query("""SELECT o_orderkey AS k, 'Contract preset: submit-only' || CASE WHEN k % 2 = 0 THEN '|When loading=true, submit button should be disabled|onSubmit is the only permitted action handler' ELSE '' END || CASE WHEN k % 3 = 0 THEN '|Loading state controls button disabled state' ELSE '' END AS submit_only,
    'Contract preset: nav-only|Component handles navigation only, no form submission or data mutation' || CASE WHEN k % 5 = 0 THEN '|Navigation target specified via href/to prop' ELSE '' END AS nav_only,
    'Contract preset: display-only|Component is purely presentational with no event handlers|All behavior driven by props only' AS display_only, 0 AS none FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def preset_predictions(spark, d):
    k, some = F.col("o_orderkey"), lambda c, v: F.array_compact(F.array(F.when(c, v), F.lit("other")))
    facets = some(k % 2 == 0, "onSubmit"), some(k % 3 == 0, "isLoading"), some(k % 5 == 0, "to")
    of = lambda preset: X.preset_predictions(preset, *facets)
    texts = [F.array_join(of(p), "|").alias(p.replace("-", "_")) for p in ("submit-only", "nav-only", "display-only")]
    return t(spark, d, "orders").select(k.alias("k"), *texts, F.size(of("none")).alias("none"))
