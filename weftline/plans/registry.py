"""Every registered query and its SQL: the engine's operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import contract as C
from weftline.operators import extract as X
from weftline.operators import graph as G
from weftline.operators import scan as S
from weftline.storage import Scratch
from weftline.streaming.watch import debounce

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TASK_KEYS = 4000  # keys whose derived texts a task reads


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of keys dealt over tasks of some TASK_KEYS each, before texts are derived from them: a table of keys is a small file or two."""
    n = max(-(-rows.count() // TASK_KEYS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, key)


def files(spark, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")


FILES = "(SELECT doc_id AS id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text FROM documents)"


def fk_graph(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """region -> nation -> customer -> order, and supplier -> nation, as nodes(id) and edges(src, dst)."""
    v = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    n, c, o, s = (t(spark, d, x) for x in ("nation", "customer", "orders", "supplier"))
    edges = n.select(v("region", "n_regionkey").alias("src"), v("nation", "n_nationkey").alias("dst"))
    edges = edges.union(c.select(v("nation", "c_nationkey"), v("customer", "c_custkey"))).union(o.select(v("customer", "o_custkey"), v("order", "o_orderkey"))).union(s.select(v("supplier", "s_suppkey"), v("nation", "s_nationkey")))
    nodes = t(spark, d, "region").select(v("region", "r_regionkey").alias("id")).union(n.select(v("nation", "n_nationkey"))).union(c.select(v("customer", "c_custkey"))).union(o.select(v("order", "o_orderkey"))).union(s.select(v("supplier", "s_suppkey")))
    return nodes, edges


EDGES = """(SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""
NODES = """(SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation
    UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'order:' || o_orderkey FROM orders
    UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier)"""


@query(f"SELECT id, path FROM {FILES} WHERE NOT regexp_matches(path, '^src1/.*$') AND NOT regexp_matches(path, '(^|/)[^/]*7$')")
def scan_filter_ignore(spark, d):
    return S.ignore(files(spark, d), ["src1/**", "*7"]).select("id", "path")


@query(f"SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n_files, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM {FILES} GROUP BY 1")
def folder_rollup(spark, d):
    f = files(spark, d).select(S.folder(F.col("path")).alias("folder"), S.tokens_gpt(F.col("text")).alias("tokens"))
    return f.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("tokens").alias("tokens"))


HASH = "'uif:' || substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 24)"


@query(f"SELECT id, {HASH} AS file_hash FROM {FILES}")
def file_hash(spark, d):
    return files(spark, d).select("id", S.file_hash(F.col("text")).alias("file_hash"))


@query(f"SELECT {HASH} AS file_hash, count(*) AS n, min(id) AS first_id, max(id) AS last_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM {FILES} GROUP BY 1 HAVING count(*) > 1")
def hash_index_dups(spark, d):
    return S.hash_groups(files(spark, d).select("id", S.file_hash(F.col("text")).alias("file_hash"), S.tokens_gpt(F.col("text")).alias("tokens")))


@query(f"SELECT id FROM {FILES} WHERE id % 5 = 0")
def hash_lock_violations(spark, d):
    """Files whose text no longer has the hash that was stored; the later text is the stored one with a mark on every fifth."""
    f = files(spark, d)
    stored = f.select("id", S.file_hash(F.col("text")).alias("stored"))
    now = f.select("id", S.file_hash(F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("fresh"))
    return stored.join(now, "id").where("stored <> fresh").select("id")


@query("""SELECT o_orderkey AS id, 'uif:' || substr(sha256('{"customer":' || o_custkey || ',"priority":"' || o_orderpriority || '","schemaVersion":"0.4","status":"' || o_orderstatus || '"}'), 1, 24) AS semantic_hash FROM orders""")
def semantic_hash_orders(spark, d):
    text = C.canonical(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"), customer=F.col("o_custkey"), schemaVersion=F.lit(C.CONTRACT_VERSION))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.short_hash(text).alias("semantic_hash"))


@query("""SELECT root, count(*) AS n_nodes, 'uifb:' || substr(sha256('{"depth":2,"nodes":' || to_json(list({'entryId': id, 'semanticHash': h} ORDER BY id)) || ',"schemaVersion":"0.1"}'), 1, 24) AS bundle_hash
    FROM (SELECT o_custkey AS root, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus || o_orderpriority AS h FROM orders) GROUP BY 1""")
def bundle_hash_customer(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").cast("string").alias("id"), F.concat("o_orderstatus", "o_orderpriority").alias("semantic_hash"))
    return G.bundle_hash(o, 2)


@query("""SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS link FROM pages)""")
def extract_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(X.all_of(F.col("html"), 'href="([^"]*)"')).alias("link"))


@query("""SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ />]', 1)) AS tag FROM pages) GROUP BY 1""")
def extract_tags(spark, d):
    tags = t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ />]"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query("""SELECT tag, n, rank FROM (SELECT tag, n, CAST(row_number() OVER (ORDER BY n DESC, tag) AS INTEGER) AS rank FROM (
    SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ />]', 1)) AS tag FROM pages) GROUP BY 1)) WHERE rank <= 20""")
def ui_topk_frequency(spark, d):
    """The twenty most frequent tags; a top-k report over one row per tag."""
    tags = extract_tags(spark, d).select("tag", "n").orderBy(F.desc("n"), "tag").limit(20)
    return tags.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "tag")))


@query("""SELECT n_nationkey, c_mktsegment AS mode FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r
    FROM customer GROUP BY 1, 2) WHERE r = 1""")
def mode_per_group(spark, d):
    n = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("n_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), "c_mktsegment")).alias("mode"))


@query("SELECT l_orderkey, CASE WHEN count(*) <= 3 THEN 'low' WHEN count(*) <= 8 THEN 'medium' ELSE 'high' END AS density FROM lineitem GROUP BY 1")
def density_bucket(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_orderkey", F.when(F.col("n") <= 3, "low").when(F.col("n") <= 8, "medium").otherwise("high").alias("density"))


@query(f"SELECT e.dst AS id, count(DISTINCT e.src) AS n_users, min(e.src) AS first_user FROM {EDGES} e GROUP BY 1")
def graph_used_by(spark, d):
    return G.used_by(fk_graph(spark, d)[1])


@query(f"SELECT id FROM {NODES} n WHERE NOT EXISTS (SELECT 1 FROM {EDGES} e WHERE e.dst = n.id)")
def graph_roots(spark, d):
    return G.roots(*fk_graph(spark, d))


@query(f"SELECT id FROM {NODES} n WHERE NOT EXISTS (SELECT 1 FROM {EDGES} e WHERE e.src = n.id)")
def graph_leaves(spark, d):
    return G.leaves(*fk_graph(spark, d))


@query("""SELECT p.url AS name, min(q.url) AS path FROM (SELECT DISTINCT regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^([^.]*)', 1) AS url FROM pages) p
    LEFT JOIN pages q ON regexp_replace(regexp_extract(q.url, '([^/]*)$', 1), '\\.[^.]*$', '') = p.url GROUP BY 1""")
def name_resolution_priority(spark, d):
    p = t(spark, d, "pages").select(F.col("url").alias("path"))
    names = p.select(F.regexp_extract(F.regexp_extract("path", "([^/]*)$", 1), "^([^.]*)", 1).alias("name")).distinct()
    return G.resolve(names, p)


REACH = f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT id AS root, id, 0 AS level FROM {NODES} n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.dst = n.id)
    UNION SELECT r.root, e.dst, r.level + 1 FROM r JOIN e ON r.id = e.src WHERE r.level < 2)"""


def fk_search(spark, d: str) -> tuple[G.Reach, DataFrame]:
    """Depth-2 bundles of fk_graph and its edges, a written table."""
    nodes, edges = fk_graph(spark, d)
    edges = Scratch(spark, "edges").put(edges)
    return G.search(G.roots(nodes, edges), edges, 2), edges


@query(f"{REACH} SELECT root, id, min(level) AS level FROM r GROUP BY 1, 2")
def bfs_depth2(spark, d):
    return fk_search(spark, d)[0].rows().select("root", "id", "level")


@query(f"{REACH} SELECT root, id, level FROM (SELECT root, id, level, row_number() OVER (PARTITION BY root ORDER BY level, id) AS k FROM (SELECT root, id, min(level) AS level FROM r GROUP BY 1, 2)) WHERE k <= 30")
def bfs_max_nodes(spark, d):
    """At most 30 nodes of each root, nearest first: the root, then 29 of those that it shares with its twins."""
    r, _ = fk_search(spark, d)
    return r.rows(S.first_per_group(r.found, "twin", ["level", "id"], 29)).select("root", "id", "level")


@query(f"{REACH} SELECT DISTINCT a.root, e.src, e.dst FROM r a JOIN e ON a.id = e.src JOIN r b ON b.root = a.root AND b.id = e.dst")
def bundle_edges(spark, d):
    r, edges = fk_search(spark, d)
    return r.edges(edges)


@query(f"{REACH} SELECT id, count(DISTINCT root) AS n_roots, min(root) AS first_root FROM r GROUP BY 1")
def reverse_index(spark, d):
    return fk_search(spark, d)[0].reverse_index()


@query(f"{REACH} SELECT DISTINCT root FROM r WHERE id LIKE 'customer:%' AND CAST(substr(id, 10) AS BIGINT) % 50 = 0")
def incremental_affected_roots(spark, d):
    changed = t(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return fk_search(spark, d)[0].affected_roots(changed)


@query(f"SELECT id, n FROM (SELECT src AS id, count(*) AS n FROM {EDGES} GROUP BY 1) ORDER BY n DESC, id LIMIT 10")
def top_complex(spark, d):
    return fk_graph(spark, d)[1].groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(10)


@query(f"SELECT id FROM {NODES} n WHERE NOT EXISTS (SELECT 1 FROM {EDGES} e WHERE e.dst = n.id OR e.src = n.id)")
def isolated(spark, d):
    nodes, edges = fk_graph(spark, d)
    return G.leaves(G.roots(nodes, edges), edges)


def snapshots(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of customer: rows without every tenth key; rows without every seventh, every fifth changed."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    new = c.where("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_mktsegment", F.lit("*"))).otherwise(F.col("c_mktsegment")))
    return c.where("c_custkey % 10 <> 0"), new


CHANGES = """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'added' WHEN c_custkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS op,
    CASE WHEN c_custkey % 10 = 0 OR c_custkey % 7 = 0 THEN 'entry' ELSE 'c_mktsegment' END AS facet FROM customer
    WHERE (c_custkey % 10 = 0) <> (c_custkey % 7 = 0) OR (c_custkey % 5 = 0 AND c_custkey % 10 <> 0 AND c_custkey % 7 <> 0)"""


@query(CHANGES)
def compare_facets(spark, d):
    return G.diff(*snapshots(spark, d), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query(f"SELECT op, facet, CASE op WHEN 'removed' THEN 'error' WHEN 'changed' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM ({CHANGES}) GROUP BY 1, 2, 3")
def violations(spark, d):
    severity = F.when(F.col("op") == "removed", "error").when(F.col("op") == "changed", "warning").otherwise("info")
    return compare_facets(spark, d).groupBy("op", "facet", severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT source, count(*) AS n_old FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1), n AS (SELECT source, count(*) AS n_new FROM documents WHERE doc_id % 7 <> 0 AND source <> 'src3' GROUP BY 1)
    SELECT coalesce(o.source, n.source) AS folder, CASE WHEN n_old IS NULL THEN 'ADDED' WHEN n_new IS NULL THEN 'ORPHANED' WHEN n_old <> n_new THEN 'DRIFT' ELSE 'PASS' END AS status FROM o FULL OUTER JOIN n ON o.source = n.source""")
def compare_folders(spark, d):
    f = t(spark, d, "documents").select("doc_id", F.col("source").alias("folder"))
    old = f.where("doc_id % 10 <> 0").groupBy("folder").agg(F.count(F.lit(1)).alias("o"))
    new = f.where("doc_id % 7 <> 0 and folder <> 'src3'").groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "ORPHANED").when(F.col("o") != F.col("n"), "DRIFT").otherwise("PASS")
    return old.join(new, "folder", "full_outer").select("folder", status.alias("status"))


@query(f"SELECT id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS gpt, CAST(ceil(length(text) / 4.5) AS BIGINT) AS claude FROM {FILES}")
def token_estimates(spark, d):
    return files(spark, d).select("id", S.tokens_gpt(F.col("text")).alias("gpt"), S.tokens_claude(F.col("text")).alias("claude"))


@query("""SELECT lang, source_tokens, CAST(ceil(0.6 * source_tokens) AS BIGINT) AS none_tokens, 2 * source_tokens AS full_tokens FROM
    (SELECT lang, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS source_tokens FROM documents GROUP BY 1)""")
def mode_savings(spark, d):
    s = t(spark, d, "documents").groupBy("lang").agg(F.sum(S.tokens_gpt(F.col("text"))).alias("source_tokens"))
    return s.select("lang", "source_tokens", F.ceil(F.lit(0.6).cast("decimal(2,1)") * F.col("source_tokens")).cast("bigint").alias("none_tokens"), (2 * F.col("source_tokens")).alias("full_tokens"))


_hits = " UNION ALL ".join(f"SELECT id, line, '{n}' AS type, '{s}' AS severity, substr(regexp_extract(code, '({p.replace(chr(39), chr(39) * 2)})', 1), 1, 40) AS snippet FROM l WHERE regexp_matches(code, '{p.replace(chr(39), chr(39) * 2)}')" for n, s, p in S.SECRETS)
LINES = "l AS (SELECT id, unnest(c) AS code, unnest(range(1, len(c) + 1)) AS line FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS c FROM documents))"


@query(f"WITH {LINES} {_hits}")
def secret_scan(spark, d):
    return S.secret_matches(files(spark, d))


@query(f"WITH {LINES}, h AS ({_hits}) SELECT id, line, type, severity, snippet FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, type) AS r FROM h) WHERE r <= 5")
def secret_top5_per_file(spark, d):
    return S.first_per_group(secret_scan(spark, d), "id", ["line", "type"], 5)


@query(r"""SELECT id, sha256(regexp_replace(regexp_replace(text, '((postgres|postgresql|mysql|mongodb)://[^:\s]+:)[^@\s]+@', '\1PRIVATE_DATA@', 'g'),
    '(?i)((api_?key|token|secret|password|passwd|pwd)["'']?\s*[:=]\s*["''])[^"''\n]{8,}(["''])', '\1PRIVATE_DATA\3', 'g')) AS masked_sha FROM """ + FILES)
def secret_mask(spark, d):
    return files(spark, d).select("id", F.sha2(S.mask(F.col("text")), 256).alias("masked_sha"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
    k AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
    SELECT user_id, CAST(b AS BIGINT) AS burst, count(*) AS n FROM k GROUP BY 1, 2""")
def watch_debounce(spark, d):
    out = debounce(t(spark, d, "events").select("user_id", "ts"), "user_id", "30 minutes")
    return out.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("session_window.start")).cast("bigint").alias("burst"), "n")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def watch_log_ring(spark, d):
    """The log keeps its 100 newest entries."""
    return t(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("""SELECT day, errors, CAST(sum(errors) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)""")
def strict_watch_running(spark, d):
    e = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.select("day", "errors", F.sum("errors").over(Window.orderBy("day")).alias("total"))


@query("""SELECT rule, severity, count(*) AS n FROM (
    SELECT 'empty text' AS rule, 'error' AS severity FROM documents WHERE length(text) = 0 UNION ALL SELECT 'wrong size', 'error' FROM documents WHERE n_chars <> length(text)
    UNION ALL SELECT 'short text', 'warning' FROM documents WHERE n_chars < 100 UNION ALL SELECT 'no label', 'warning' FROM documents x WHERE NOT EXISTS (SELECT 1 FROM labels y WHERE y.doc_id = x.doc_id)) GROUP BY 1, 2""")
def validate_bundles(spark, d):
    docs = t(spark, d, "documents")
    labelled = t(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    rule = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
    n = F.length("text")
    broken = F.array(rule(n == 0, "empty text", "error"), rule(F.col("n_chars") != n, "wrong size", "error"), rule(F.col("n_chars") < 100, "short text", "warning"), rule(F.col("labelled").isNull(), "no label", "warning"))
    return docs.join(labelled, "doc_id", "left").select(F.explode(F.array_compact(broken)).alias("r")).groupBy("r.rule", "r.severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"{REACH} SELECT count(DISTINCT root) AS n_bundles, count(*) AS n_nodes, max(level) AS depth FROM (SELECT root, id, min(level) AS level FROM r GROUP BY 1, 2)")
def stats_output(spark, d):
    return fk_search(spark, d)[0].totals()


@query("""SELECT page_id, '/' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*/(.*?)[^/]*$', 1), '/$', '') AS segment FROM pages""")
def next_segment_path(spark, d):
    as_app = F.regexp_replace("url", "^[a-z]+://[^/]*/", "app/")
    return t(spark, d, "pages").select("page_id", X.segment_path(as_app).alias("segment"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Stateful' WHEN c_acctbal < 5000 THEN 'Interactive' ELSE 'Presentational' END || ' component' AS description,
    list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END, CASE WHEN c_nationkey < 10 THEN 'near' END], lambda x: x IS NOT NULL) AS predictions FROM customer""")
def describe_rows(spark, d):
    b = F.col("c_acctbal")
    p = F.array_compact(F.array(F.when(b < 0, "debt"), F.when(F.col("c_mktsegment") == "BUILDING", "building"), F.when(F.col("c_nationkey") < 10, "near")))
    return t(spark, d, "customer").select("c_custkey", F.concat(F.when(b < 0, "Stateful").when(b < 5000, "Interactive").otherwise("Presentational"), F.lit(" component")).alias("description"), p.alias("predictions"))
