"""Statistics of a run: its one-row statistics, the table of modes, the missing names to show, and the index over folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import base_name, root_label

# Characters a token of the two models, and the ratios by which one mode's tokens are estimated from another's.
CHARS = {"gpt4": "4", "claude": "4.5"}
NONE_OF_HEADER, HEADER_OF_SOURCE, STYLE_OF_HEADER = "0.6", "0.30", "2.05"
HEADER_OF_OTHER, STYLE_OF_OTHER = "0.75", "0.85"
SHOWN_NAMES = 10


def _dec(v: str) -> Column:
    return F.lit(v).cast("decimal(4,2)")


def _ceil(v: Column) -> Column:
    return F.ceil(v).cast("bigint")


def tokens(chars: Column, model: str) -> Column:
    return _ceil(chars.cast("decimal(20,0)") / _dec(CHARS[model]))


def _percent(part: Column, whole: Column) -> Column:
    """Share saved against whole, without decimals, as text; 0 if there is nothing."""
    return F.when(whole > 0, F.floor((whole - part) * 100 / whole + 0.5).cast("bigint")).otherwise(F.lit(0).cast("bigint")).cast("string")


def _one(*tables: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), tables)


def run_stats(contracts: DataFrame, edges: DataFrame, bundles: DataFrame, written: DataFrame, sources: DataFrame) -> DataFrame:
    """One row about a run: components, roots, leaves, bundles, nodes, edges, missing, tokens, estimates by mode, savings.

    contracts(id); edges(src, dst) between them; bundles(n_nodes, n_edges, n_missing); written(line): what the bundles are
    written as, lines joined by line ends; sources(text). Counts are taken on all rows, without a global sort or a collected set;
    empty tables count 0. A root has no user, a leaf uses nothing.
    """
    ends = contracts.select("id", F.lit(1).alias("here"), F.lit(0).alias("used"), F.lit(0).alias("uses"))
    ends = ends.union(edges.select("dst", F.lit(0), F.lit(1), F.lit(0))).union(edges.select("src", F.lit(0), F.lit(0), F.lit(1)))
    each = ends.groupBy("id").agg(F.max("here").alias("here"), F.max("used").alias("used"), F.max("uses").alias("uses"))
    flag = lambda c, name: F.count_if(c).alias(name)
    nodes = each.agg(flag(F.col("here") == 1, "total_components"), flag((F.col("here") == 1) & (F.col("used") == 0), "root_components"), flag((F.col("here") == 1) & (F.col("uses") == 0), "leaf_components"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    graph = bundles.agg(F.count(F.lit(1)).alias("bundles_generated"), total(F.col("n_nodes"), "total_nodes"), total(F.col("n_edges"), "total_edges"), total(F.col("n_missing"), "missing_dependencies"))
    size = written.agg(F.greatest(total(F.char_length("line").cast("bigint") + 1, "n") - 1, F.lit(0)).alias("_out"))
    source = sources.agg(total(F.char_length("text").cast("bigint"), "_source"))
    out = _one(nodes, graph, size, source)
    now = {m: tokens(F.col("_out"), m) for m in CHARS}
    full = {m: now[m] + tokens(F.col("_source"), m) for m in CHARS}
    estimates = F.struct(*[
        F.struct(*[v[m].alias(m) for m in CHARS]).alias(mode)
        for mode, v in (("none", {m: _ceil(now[m] * _dec(NONE_OF_HEADER)) for m in CHARS}), ("header", now), ("full", full))
    ])
    return out.select(
        "total_components", "root_components", "leaf_components", "bundles_generated", "total_nodes", "total_edges", "missing_dependencies", now["gpt4"].alias("tokens_gpt4"), now["claude"].alias("tokens_claude"),
        estimates.alias("mode_estimates"), _percent(now["gpt4"], full["gpt4"]).alias("savings_gpt4"), _percent(now["claude"], full["claude"]).alias("savings_claude"),
    )


def mode_table(stats: DataFrame, source_chars: Column, mode: str = "header", with_style: bool = False) -> DataFrame:
    """(place, mode, gpt4, claude, savings) of raw source, header and header+style, from the tokens of run_stats().

    In header mode the raw source is estimated from the header, else it is counted. savings is text, against gpt4 of the source.
    """
    now = {m: F.col(f"tokens_{m}") for m in CHARS}
    if mode == "header":
        header = {m: _ceil(now[m] / _dec(STYLE_OF_HEADER)) if with_style else now[m] for m in CHARS}
        style = {m: now[m] if with_style else _ceil(now[m] * _dec(STYLE_OF_HEADER)) for m in CHARS}
        source = {m: _ceil(header[m] / _dec(HEADER_OF_SOURCE)) for m in CHARS}
    else:
        header, style = ({m: _ceil(now[m] * _dec(r)) for m in CHARS} for r in (HEADER_OF_OTHER, STYLE_OF_OTHER))
        source = {m: tokens(source_chars, m) for m in CHARS}
    rows = [
        F.struct(F.lit(k).alias("place"), F.lit(name).alias("mode"), v["gpt4"].alias("gpt4"), v["claude"].alias("claude"), _percent(v["gpt4"], source["gpt4"]).alias("savings"))
        for k, (name, v) in enumerate((("source", source), ("header", header), ("header+style", style)), 1)
    ]
    return stats.select(F.inline(F.array(*rows)))


def missing_names(missing: DataFrame, shown: int = SHOWN_NAMES) -> DataFrame:
    """(place, name, n_bundles, more): the first names that bundles lack, by the first bundle that lacks them, then by name;
    more is how many further names there are. missing(root, name). Names are first made distinct, so one name's bundles never meet."""
    each = missing.groupBy("name").agg(F.min("root").alias("_first"), F.count_distinct("root").alias("n_bundles"))
    first = each.orderBy("_first", "name").limit(shown)
    place = F.posexplode(F.array_sort(F.collect_list(F.struct("_first", "name", "n_bundles"))))
    top = first.agg(place).select((F.col("pos") + 1).alias("place"), "col.name", "col.n_bundles")  # at most `shown` rows
    return top.join(F.broadcast(each.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more"))))


def folder_index(lines: DataFrame, members: DataFrame, extension: str = "json") -> DataFrame:
    """(folder, context_file, bundles, is_root, root_label, token_estimate): one row per folder for the main index.

    lines(folder, line): what each bundle is written as, so that the estimate is that of the whole file; members(folder,
    entry_id). Both are added up before the shuffle, so a folder of any size is one small row; the names in a folder stand in
    folder_components().
    """
    size = lines.groupBy("folder").agg(F.count(F.lit(1)).alias("bundles"), (F.sum(F.char_length("line").cast("bigint")) + F.count(F.lit(1)) - 1).alias("_n"))
    app = lambda name: F.max(F.when(base_name(F.col("entry_id")) == name, F.lit(name)))
    files = members.groupBy("folder").agg(F.array_compact(F.array(app("page.tsx"), app("layout.tsx"))).alias("_files"))
    name = F.lit(f"context.{extension}")
    label = root_label(F.col("folder"), F.coalesce("_files", F.array().cast("array<string>")))
    return size.join(files, "folder", "left").select(
        "folder", F.when(F.col("folder") == ".", name).otherwise(F.concat(F.col("folder"), F.lit("/"), name)).alias("context_file"), "bundles", label.isNotNull().alias("is_root"),
        label.alias("root_label"), tokens(F.col("_n"), "gpt4").alias("token_estimate"),
    )


def folder_components(members: DataFrame) -> DataFrame:
    """(folder, component): the file names of a folder's bundles, one row each, to be sorted where they are written."""
    return members.select("folder", base_name(F.col("entry_id")).alias("component"))


def index_totals(folders: DataFrame, n_contracts: DataFrame) -> DataFrame:
    """One row: total_components, total_bundles, total_folders, total_token_estimate. n_contracts: contracts, to be counted."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    made = folders.agg(total(F.col("bundles")).alias("total_bundles"), F.count(F.lit(1)).alias("total_folders"), total(F.col("token_estimate")).alias("total_token_estimate"))
    return _one(n_contracts.agg(F.count(F.lit(1)).alias("total_components")), made)
