"""Security reports met with files, and masking at the reported places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import normalize

MATCH = "array<struct<line:bigint,column:bigint,type:string,snippet:string>>"
MASK = "PRIVATE_DATA"
TASK_ROWS = 20_000  # files or matches that a task meets


def _same(path: Column) -> Column:
    return F.lower(normalize(path))


def _under(root: str, path: Column) -> Column:
    return F.when(path.rlike(r"^(?:/|[A-Za-z]:)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def _tasks(*tables: DataFrame) -> int:
    """Tasks that the largest of the tables is dealt over: their number grows with its rows, so what one task holds does not."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, *(-(-x.count() // TASK_ROWS) for x in tables))


def match_report(files: DataFrame, report: DataFrame, report_root: str, root: str, tasks: int | None = None) -> DataFrame:
    """files(path) with the rows of report(file, line, column, type, snippet) that mean them: path and the report's columns.

    A reported file means the file at its path below the report's root, else the one below the present root, else the one with
    the same relative path; the first of these keys that meets counts, and a match is given once. Paths compare without case.
    Each key is an equi-join, so no file is compared with every match. Rows are dealt over tasks by number, since their bytes,
    by which Spark would put them together, are few beside what a task holds of them; the result is dealt by path.
    """
    n = tasks or _tasks(files, report)
    rows = report.withColumn("_id", F.xxhash64(*report.columns)).repartition(n, "_id").distinct()
    other = _same(F.lit(report_root)) != _same(F.lit(root))
    relative = ~F.col("file").rlike(r"^(?:/|[A-Za-z]:)")
    key = lambda rank, kind, text, when=F.lit(True): F.when(when, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), text.alias("key")))
    of_report = [key(0, "whole", _same(_under(report_root, F.col("file")))), key(1, "whole", _same(_under(root, F.col("file"))), other & relative), key(2, "relative", _same(F.col("file")), other & relative)]
    of_file = [key(0, "whole", _same(_under(root, F.col("path")))), key(0, "relative", _same(F.col("path")))]
    left = rows.select("*", F.inline(F.array_compact(F.array(*of_report)))).repartition(n, "kind", "key")
    right = files.select("path").repartition(n, "path").distinct().select("path", F.inline(F.array_compact(F.array(*of_file)))).drop("rank").repartition(n, "kind", "key")
    met = left.join(right.hint("merge"), ["kind", "key"]).repartition(n, "path")
    first = F.row_number().over(Window.partitionBy("_id", "path", *report.columns).orderBy("rank"))
    return met.withColumn("_r", first).where("_r = 1").select("path", *report.columns)


def _mask_one(line: Column, m: Column) -> Column:
    """A line without the secret that a match's snippet shows."""
    part = lambda p, g=1: F.regexp_extract(m["snippet"], p, g)
    url = r"((?i:postgres|postgresql|mysql|mongodb)://[^:]+:)([^@]+)(@)"
    password = part(url, 2)
    quoted = r"(['\"`])((?i:postgres|postgresql|mysql|mongodb)://[^:]+:)([^@]+)(@[^'\"`]+)\1"
    of_url = F.when(line.rlike(quoted), F.regexp_replace(line, quoted, f"$1$2{MASK}$4$1")).when(password != "", F.replace(line, password, F.lit(MASK))).otherwise(line)
    quote, value = part(r"[=:]\s*(['\"`])([^'\"`]+)\1", 1), part(r"[=:]\s*(['\"`])([^'\"`]+)\1", 2)
    whole = F.concat(quote, value, quote)
    of_quoted = F.when(F.instr(line, whole) > 0, F.replace(line, whole, F.concat(quote, F.lit(MASK), quote))).otherwise(F.replace(line, value, F.lit(MASK)))
    bare = part(r"[=:]\s+([a-zA-Z0-9_\-]{16,})")
    of_bare = F.regexp_replace(line, F.concat(F.lit(r"\b\Q"), bare, F.lit(r"\E\b")), F.lit(MASK))
    key = F.regexp_replace(line, r"(-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----)[\s\S]*?(-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----)", f"$1\n{MASK}\n$2")
    long = part(r"([a-zA-Z0-9_\-]{20,})")
    return (
        F.when(m["type"] == "Database URL with Credentials", of_url).when(value != "", of_quoted).when(bare != "", of_bare)
        .when((m["type"] == "Private Key") & line.contains("BEGIN"), key).when((long != "") & ~line.contains(MASK), F.replace(line, long, F.lit(MASK))).otherwise(line)
    )


def mask_lines(text: Column, matches: Column) -> Column:
    """text with its reported secrets masked, line by line from the right; matches as MATCH, columns and lines from 1."""
    lines = F.split(text, "\n")
    order = F.reverse(F.array_sort(F.transform(matches, lambda m: F.struct(m["column"].alias("column"), m["line"].alias("line"), m["type"].alias("type"), m["snippet"].alias("snippet")))))
    on = lambda k: F.filter(order, lambda m: m["line"] == k + 1)
    masked = F.transform(lines, lambda s, k: F.aggregate(on(k), s, _mask_one))
    return F.when(F.size(matches) > 0, F.array_join(masked, "\n")).otherwise(text)


def mask_by_report(files: DataFrame, report: DataFrame, report_root: str, root: str) -> DataFrame:
    """files(path, text) with masked and n_masked: the secrets of a report taken out of the files that it means."""
    n = _tasks(files, report)
    met = match_report(files, report, report_root, root, n)
    held = met.groupBy("path").agg(F.collect_list(F.struct("line", "column", "type", "snippet")).alias("_m"))
    out = files.repartition(n, "path").join(held.hint("merge"), "path", "left").withColumn("_m", F.coalesce(F.col("_m").cast(MATCH), F.array().cast(MATCH)))
    return out.withColumns({"masked": mask_lines(F.col("text"), F.col("_m")), "n_masked": F.size("_m")}).drop("_m")
