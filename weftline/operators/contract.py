"""Contracts: hashes, differences, violations, validation, and the filters that bundles need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import json_string, record

CONTRACT = "UIFContract"  # the type of a contract
CONTRACT_VERSION, BUNDLE_VERSION = "0.4", "0.1"
SETS, MAPS = ("hooks", "components", "variables", "functions"), ("props", "emits", "state")

# Violation types and severities by (facet, op).
VIOLATIONS = {
    ("props", "removed"): ("breaking_change_prop_removed", "error"), ("props", "changed"): ("breaking_change_prop_type", "warning"),
    ("emits", "removed"): ("breaking_change_event_removed", "error"), ("state", "removed"): ("breaking_change_state_removed", "warning"),
    ("functions", "removed"): ("breaking_change_function_removed", "error"), ("variables", "removed"): ("breaking_change_variable_removed", "warning"),
}


# ---- hashes -----------------------------------------------------------------------------------------------------------


def short_hash(text: Column, prefix: str = "uif:") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 24))


def canonical(**facets: Column) -> Column:
    """JSON text with keys in order; arrays of strings are sorted, nulls left out."""
    return F.to_json(F.struct(*[facets[k].alias(k) for k in sorted(facets)]))


def _sorted(items: Column) -> Column:
    return F.array_sort(F.coalesce(items, F.array().cast("array<string>")))


def _object(**fields: Column) -> Column:
    """A JSON object of texts that are JSON already, fields in order; nulls are left out."""
    pairs = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ","), F.lit("}"))


def _structure(variables: Column, hooks: Column, components: Column, functions: Column) -> Column:
    return canonical(variables=_sorted(variables), hooks=_sorted(hooks), components=_sorted(components), functions=_sorted(functions))


def _signature(props: Column, emits: Column, state: Column, api: Column | None = None) -> Column:
    """Objects by name: a prop is its type alone or, if it is optional, a union or a function, an object."""

    def prop(p: Column) -> Column:
        plain = p["optional"].isNull() & p["literals"].isNull() & p["signature"].isNull()
        return F.when(plain, json_string(p["type"])).otherwise(F.to_json(F.struct(p["literals"].alias("literals"), p["optional"].alias("optional"), p["signature"].alias("signature"), p["type"].alias("type"))))

    event = lambda e: F.to_json(F.struct(e["signature"].alias("signature"), F.lit("function").alias("type")))
    held = F.when(F.size(state) > 0, record(state, "name", lambda v: json_string(v["type"])))
    given = {"props": record(props, "name", prop), "emits": record(emits, "name", event), "state": held}
    return _object(**given, **({"apiSignature": api} if api is not None else {}))


def structure_hash(variables: Column, hooks: Column, components: Column, functions: Column) -> Column:
    return short_hash(_structure(variables, hooks, components, functions))


def signature_hash(props: Column, emits: Column, state: Column, api: Column | None = None) -> Column:
    """props, emits and state as arrays of structs that begin with a name, in any order; api is canonical JSON."""
    return short_hash(_signature(props, emits, state, api))


def api_json(api: Column) -> Column:
    """Canonical JSON of an API signature; null without one."""
    given = {"parameters": F.when(F.size(api["parameters"]) > 0, record(api["parameters"], "name", lambda p: json_string(p["type"]))), "returnType": F.when(api["return_type"].isNotNull(), json_string(api["return_type"]))}
    return F.when(api.isNotNull(), _object(**given))


def backend_json(framework: Column, routes: Column, controller: Column, decorators: Column, annotations: Column) -> Column:
    """Canonical JSON of a server file's metadata: routes by method and path, parameters and decorators sorted; null without a framework."""
    each = F.array_sort(F.transform(routes, lambda r: F.struct(r["method"].alias("method"), r["path"].alias("path"), r["handler"].alias("handler"), F.array_sort(r["params"]).alias("params"))))
    ordered = F.transform(each, lambda r: F.struct(r["handler"].alias("handler"), r["method"].alias("method"), r["params"].alias("params"), r["path"].alias("path")))
    classes = F.when(controller["name"].isNotNull(), F.array(controller["name"]))
    some = lambda items: F.when(F.size(items) > 0, F.array_sort(items))
    language = F.struct(some(annotations).alias("annotations"), classes.alias("classes"), some(decorators).alias("decorators"))
    has = F.coalesce(F.size(annotations), F.lit(0)) + F.coalesce(F.size(decorators), F.lit(0)) + F.when(classes.isNotNull(), 1).otherwise(0) > 0
    place = F.when(controller.isNotNull(), F.struct(controller["base_path"].alias("basePath"), controller["name"].alias("name")))
    parts = F.struct(place.alias("controller"), framework.alias("framework"), F.when(has, language).alias("languageSpecific"), F.when((F.size(ordered) > 0) | (framework == "nest"), ordered).alias("routes"))
    return F.when(framework.isNotNull(), F.to_json(parts))


def semantic_hash(structure: Column, signature: Column, backend: Column | None = None) -> Column:
    """Of structure, signature and backend as canonical JSON; not of imports, exports, kind or style."""
    given = {"schemaVersion": F.lit(f'"{CONTRACT_VERSION}"'), "structure": structure, "signature": signature} | ({"backend": backend} if backend is not None else {})
    return short_hash(_object(**given))


def with_hashes(contracts: DataFrame) -> DataFrame:
    """contract rows plus structure_hash, signature_hash and semantic_hash."""
    structure, signature = _structure(*[F.col(c) for c in ("variables", "hooks", "components", "functions")]), _signature(*[F.col(c) for c in MAPS], api_json(F.col("api_signature")))
    made = contracts.select("*", F.explode(F.array(F.struct(structure.alias("a"), signature.alias("b")))).alias("_json"))
    a, b = F.col("_json.a"), F.col("_json.b")
    hashes = {"structure_hash": short_hash(a), "signature_hash": short_hash(b), "semantic_hash": semantic_hash(a, b, backend_json(*[F.col(c) for c in ("framework", "routes", "controller", "decorators", "annotations")]))}
    return made.withColumns(hashes).drop("_json")


def valid_hash(h: Column) -> Column:
    return h.rlike(r"^uif:[a-f0-9]{24}$")


def is_contract(kind: Column, version: Column, expected: str = CONTRACT) -> Column:
    return F.coalesce((kind == expected) & (version == CONTRACT_VERSION), F.lit(False))


# ---- components that a file defines for itself ------------------------------------------------------------------------


def without_internal(components: Column, functions: Column, exports: Column) -> Column:
    """Components but those that are local functions and not exported; only a list of exported names can tell."""
    inner = F.array_except(F.array_intersect(components, functions), exports["named"])
    return F.when(exports["form"] == "list", F.array_except(components, inner)).otherwise(components)


def is_internal(name: Column, components: Column, functions: Column) -> Column:
    return F.array_contains(components, name) & F.array_contains(functions, name)


def missing_from_outside(missing: DataFrame, contracts: DataFrame) -> DataFrame:
    """missing(root, name, referenced_by) without names that the referencing file defines itself; contracts(id, components, functions)."""
    own = contracts.select(F.col("id").alias("referenced_by"), F.explode(F.array_intersect("components", "functions")).alias("name"))
    return missing.join(own, ["referenced_by", "name"], "left_anti")


# ---- differences ------------------------------------------------------------------------------------------------------


def _entries(facet: str, op: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(facet).alias("facet"), F.lit(op).alias("op"), n.alias("name")))


def _map_diff(facet: str, old: Column, new: Column) -> list[Column]:
    names = lambda m: F.transform(m, lambda x: x["name"])
    changed = F.filter(new, lambda x: F.array_contains(names(old), x["name"]) & ~F.array_contains(old, x))
    return [_entries(facet, "added", F.array_except(names(new), names(old))), _entries(facet, "removed", F.array_except(names(old), names(new))), _entries(facet, "changed", names(changed))]


def contract_diff(old: DataFrame, new: DataFrame, key: str = "id", sets: tuple[str, ...] = SETS, maps: tuple[str, ...] = MAPS) -> DataFrame:
    """(key, facet, op, name) for contracts on both sides: names added to and removed from sets, and added, removed and changed in maps.

    Sets are arrays of strings, maps arrays of structs whose first field is name. Null counts as empty.
    """
    side = lambda df, s: df.select(key, *[F.coalesce(c, F.array().cast(dict(df.dtypes)[c])).alias(s + c) for c in (*sets, *maps)])
    both, parts = side(old, "o_").join(side(new, "n_"), key), []
    for c in sets:
        parts += [_entries(c, "added", F.array_except(f"n_{c}", f"o_{c}")), _entries(c, "removed", F.array_except(f"o_{c}", f"n_{c}"))]
    for c in maps:
        parts += _map_diff(c, F.col(f"o_{c}"), F.col(f"n_{c}"))
    return both.select(key, F.inline(F.concat(*parts)))


def changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(id, op, semantic, file): added, removed or changed contracts, and which of the two hashes changed; ids compare without case."""
    side = lambda df, s: df.select(F.lower(key).alias("_k"), F.col(key).alias(f"{s}_id"), F.col("semantic_hash").alias(f"{s}_s"), F.col("file_hash").alias(f"{s}_f"))
    both = side(old, "o").join(side(new, "n"), "_k", "full_outer")
    semantic, file = ~F.col("o_s").eqNullSafe(F.col("n_s")), ~F.col("o_f").eqNullSafe(F.col("n_f"))
    op = F.when(F.col("o_id").isNull(), "added").when(F.col("n_id").isNull(), "removed").when(semantic | file, "changed")
    return both.select(F.coalesce("n_id", "o_id").alias("id"), op.alias("op"), ((op == "changed") & semantic).alias("semantic"), ((op == "changed") & file).alias("file")).where("op is not null")


def violations(found: DataFrame, differences: DataFrame, missing: DataFrame) -> DataFrame:
    """(type, severity, id, name): what a strict watch objects to.

    found as of changes(), differences as of contract_diff(), missing(name). Only contracts whose semantic hash changed can
    break something; removed hooks and components never do.
    """
    gone = found.where("op = 'removed'").select(F.lit("contract_removed").alias("type"), F.lit("error").alias("severity"), "id", F.lit(None).cast("string").alias("name"))
    lost = missing.select("name").distinct().select(F.lit("missing_dependency"), F.lit("warning"), F.lit("project"), "name")
    rule = reduce(lambda c, kv: c.when((F.col("facet") == kv[0][0]) & (F.col("op") == kv[0][1]), F.struct(F.lit(kv[1][0]).alias("type"), F.lit(kv[1][1]).alias("severity"))), VIOLATIONS.items(), F)
    broken = differences.join(found.where("op = 'changed' and semantic").select("id"), "id", "left_semi").withColumn("_v", rule).where("_v is not null")
    return gone.union(lost).union(broken.select("_v.type", "_v.severity", "id", "name"))


# ---- API --------------------------------------------------------------------------------------------------------------


def api_aggregate(routes: DataFrame, key: str = "id") -> DataFrame:
    """Per file the parameters of all its routes and the first return type, request type (of POST, PUT, PATCH) and response type.

    routes: key, n (order), method, params (array), parameters (array<struct<name, type>>), return_type, request_type,
    response_type. A parameter of unknown type is a string; any other type found outranks that, the first first.
    """
    params = F.concat(F.transform("params", lambda p: F.struct(p.alias("name"), F.lit("string").alias("type"))), F.coalesce("parameters", F.array().cast("array<struct<name:string,type:string>>")))
    each = routes.select(key, "n", F.posexplode(params).alias("k", "p")).groupBy(key, "p.name").agg(F.min_by("p.type", F.struct((F.col("p.type") == "string"), "n", "k")).alias("type"))
    each = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("parameters"))
    first = lambda c, cond=F.lit(True): F.min_by(c, F.when(cond & F.col(c).isNotNull(), F.col("n"))).alias(c)
    types = routes.groupBy(key).agg(first("return_type"), first("request_type", F.col("method").isin("POST", "PUT", "PATCH")), first("response_type"))
    return types.join(each, key, "left")


# ---- validation -------------------------------------------------------------------------------------------------------

BUNDLE_SCHEMA = (
    "type string, schemaVersion string, entryId string, bundleHash string, "
    "graph struct<nodes:array<struct<entryId:string,contract:struct<type:string,schemaVersion:string>>>,edges:array<array<string>>>, meta struct<missing:array<struct<name:string,reason:string,referencedBy:string>>>"
)


def findings(bundles: DataFrame, bundle_type: str, contract_type: str = CONTRACT) -> DataFrame:
    """bundles (BUNDLE_SCHEMA and any other columns) to one row per broken rule: rule, severity beside the columns of the bundle.

    Types must be the expected ones, whole. A graph without nodes, edges or both breaks one rule; its nodes are looked at all
    the same if they are there.
    """
    rule = lambda bad, name, severity: F.array(F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))))
    node = lambda bad, name, severity: F.transform(F.filter("graph.nodes", lambda n: F.coalesce(bad(n["contract"]), F.lit(True))), lambda n: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
    none = F.array().cast("array<struct<rule:string,severity:string>>")
    broken = F.concat(
        rule(F.col("type") != bundle_type, "bundle type", "error"), rule(F.col("schemaVersion") != BUNDLE_VERSION, "bundle version", "error"), rule(F.col("entryId") == "", "entry id", "error"),
        rule(F.col("graph.nodes").isNull() | F.col("graph.edges").isNull(), "graph", "error"), rule(F.col("meta.missing").isNull(), "missing", "error"),
        F.coalesce(node(lambda c: c["type"] != contract_type, "contract type", "error"), none), F.coalesce(node(lambda c: c["schemaVersion"] != CONTRACT_VERSION, "contract version", "warning"), none),
        rule(F.col("bundleHash").isNotNull() & ~F.coalesce(F.col("bundleHash").rlike(r"^uifb:[a-f0-9]{24}$"), F.lit(True)), "bundle hash", "warning"),
    )
    return bundles.withColumn("_f", F.explode(F.array_compact(broken))).select(*bundles.columns, "_f.rule", "_f.severity")


def validate(bundles: DataFrame, bundle_type: str, contract_type: str = CONTRACT) -> DataFrame:
    return findings(bundles, bundle_type, contract_type).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def validate_folders(bundles: DataFrame, bundle_type: str, contract_type: str = CONTRACT) -> DataFrame:
    """bundles with a folder to (folder, bundles, errors, warnings), and one row with a null folder for all of them."""
    n = findings(bundles, bundle_type, contract_type).groupBy("folder").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    each = bundles.groupBy("folder").agg(F.count(F.lit(1)).alias("bundles")).join(n, "folder", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.rollup("folder").agg(total("bundles"), total("errors"), total("warnings"))
