"""Filters, projections, hashes and secrets over files: rows (path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import folder, package_name, root_label

HEADER_BLOCK = r"(/\*\*(?=[^@]*+(?:@(?!uif)[^@]*+)*+@uif)(?:[^*]++|\*(?!/))*+\*/)"
HEADER = r"(?s)\A(.*?)/\*\*.*?@uif.*?\*/\n*"
# Secret types with severity, pattern in the common subset of Java and RE2.
SECRETS = [
    ("API Key", "high", r"(?i)api_?key[\"']?\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']"),
    ("AWS Access Key", "high", r"AKIA[0-9A-Z]{16}"),
    ("GitHub Token", "high", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("Private Key", "high", r"-----BEGIN (RSA )?PRIVATE KEY-----"),
    ("Password", "high", r"(?i)(password|passwd|pwd)[\"']?\s*[:=]\s*[\"'][^\"']{8,}[\"']"),
    ("Token", "high", r"(?i)(auth|bearer)?_?token[\"']?\s*[:=]\s*[\"'][A-Za-z0-9_.\-]{20,}[\"']"),
    ("OAuth Secret", "high", r"(?i)client_?secret[\"']?\s*[:=]\s*[\"'][A-Za-z0-9_\-]{16,}[\"']"),
    ("Database URL with Credentials", "high", r"(postgres|postgresql|mysql|mongodb)://[^:\s]+:[^@\s]+@"),
    ("JWT Secret", "high", r"(?i)jwt_?secret[\"']?\s*[:=]\s*[\"'][^\"']{16,}[\"']"),
    ("Generic Secret", "medium", r"(?i)secret(_key)?[\"']?\s*[:=]\s*[\"'][^\"']{16,}[\"']"),
]

# Lower-case words of which a text must hold one to match any of these patterns.
HINTS = ("api", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "private key", "passw", "pwd", "token", "secret", "://")
# Names whose assigned values are masked.
MASKED = r"(?i)((?:api_?key|(?:auth|bearer)?_?token|client_?secret|jwt_?secret|secret_?key|secret|password|passwd|pwd)[\"']?\s*[:=]\s*"
FALSE_POSITIVES = r"(?i)example|sample|placeholder|dummy|your[_-]|(^|/)tests?/"


def ignore(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files that match none of the glob patterns; * stays within a segment, ** crosses segments, no slash means base name."""
    import re

    def regex(p: str) -> str:
        body = re.escape(p).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace("\0", ".*")
        return f"^{body}$" if "/" in p else f"(^|/){body}$"

    keep = F.lit(True)
    for p in patterns:
        keep &= ~F.col("path").rlike(regex(p))
    return files.where(keep)


def file_hash(text: Column) -> Column:
    """uif: and 24 hex digits of the text without its first header and with LF line ends."""
    body = F.replace(F.regexp_replace(text, HEADER, "$1"), F.lit("\r\n"), F.lit("\n"))
    return F.concat(F.lit("uif:"), F.substring(F.sha2(body, 256), 1, 24))


def hash_groups(files: DataFrame, key: str = "id") -> DataFrame:
    """Texts that occur more than once, with size and first id."""
    return files.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.sum("tokens").alias("tokens")).where("n > 1")


def tokens_gpt(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("bigint")


def tokens_claude(text: Column) -> Column:
    return F.ceil(F.length(text) / 4.5).cast("bigint")


def _suspects(files: DataFrame) -> DataFrame:
    """Lines (id, line from 0, code) of files that hold any hint; most texts end here, without a single pattern."""
    low = F.lower("text")
    some = low.contains(HINTS[0])
    for h in HINTS[1:]:
        some |= low.contains(h)
    return files.where(some).select("id", F.posexplode(F.split("text", "\n")).alias("line", "code"))


def secret_matches(files: DataFrame) -> DataFrame:
    """id, line, type, severity, snippet of the first match of each pattern in each line; one pass, each pattern runs once."""
    found = lambda p: F.nullif(F.regexp_extract("code", f"({p})", 1), F.lit(""))
    hits = F.transform(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.substring(found(p), 1, 40).alias("snippet")) for t, s, p in SECRETS]), lambda h: F.when(h["snippet"].isNotNull(), h))
    out = _suspects(files).select("id", (F.col("line") + 1).cast("bigint").alias("line"), F.explode(F.array_compact(hits)).alias("h"))
    return out.select("id", "line", "h.type", "h.severity", "h.snippet")


def all_secret_matches(files: DataFrame, filtered: bool = True) -> DataFrame:
    """id, line, column (from 1), type, severity, snippet of every match; filtered leaves out examples, comments and short generic ones."""
    locate = lambda m, at: F.call_function("locate", m, F.col("code"), at)

    def placed(p: str) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<column:int,snippet:string>>").alias("out"))
        return F.aggregate(
            F.regexp_extract_all("code", F.lit(f"({p})"), F.lit(1)), start,
            lambda acc, m: F.struct((locate(m, acc["at"]) + F.char_length(m)).alias("at"), F.concat(acc["out"], F.array(F.struct(locate(m, acc["at"]).alias("column"), F.substring(m, 1, 40).alias("snippet")))).alias("out")),
        )["out"]

    def rows(kind: str, severity: str, p: str) -> Column:
        return F.transform(placed(p), lambda x: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), x["column"].alias("column"), x["snippet"].alias("snippet")))

    each = [rows(*s) for s in SECRETS]
    out = _suspects(files)
    if filtered:
        out = out.where(~F.col("code").rlike(r"^\s*(//|#|\*|/\*)") & ~F.col("code").rlike(FALSE_POSITIVES))
    out = out.select("id", (F.col("line") + 1).cast("bigint").alias("line"), F.inline(F.concat(*each))).withColumn("column", F.col("column").cast("bigint"))
    return out.where("severity <> 'medium' or length(snippet) >= 20") if filtered else out


def mask(text: Column) -> Column:
    """Quoted values of some secret assignments and passwords in database URLs become PRIVATE_DATA; private keys and bare tokens stay."""
    text = F.regexp_replace(text, r"((postgres|postgresql|mysql|mongodb)://[^:\s]+:)[^@\s]+@", "$1PRIVATE_DATA@")
    return F.regexp_replace(text, r"(?i)((api_?key|token|secret|password|passwd|pwd)[\"']?\s*[:=]\s*[\"'])[^\"'\n]{8,}([\"'])", "$1PRIVATE_DATA$3")


def mask_all(text: Column) -> Column:
    """Every kind of secret becomes PRIVATE_DATA: passwords in database URLs, quoted values, unquoted ones of 16 characters or
    more, key blocks (over lines), and keys and tokens known by their prefix."""
    text = F.regexp_replace(text, r"((?:postgres|postgresql|mysql|mongodb)://[^:\s]+:)[^@\s]+@", "$1PRIVATE_DATA@")
    text = F.regexp_replace(text, MASKED + r"[\"'`])[^\"'`\n]{8,}([\"'`])", "$1PRIVATE_DATA$2")
    text = F.regexp_replace(text, MASKED + r")[A-Za-z0-9_\-]{16,}", "$1PRIVATE_DATA")
    text = F.regexp_replace(text, r"(?s)(-----BEGIN (?:RSA )?PRIVATE KEY-----).*?(-----END (?:RSA )?PRIVATE KEY-----)", "$1\nPRIVATE_DATA\n$2")
    return F.regexp_replace(text, r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}", "PRIVATE_DATA")


def code_header(text: Column) -> Column:
    """The first header comment, else null."""
    return F.nullif(F.regexp_extract(text, HEADER_BLOCK, 1), F.lit(""))


def mode_estimates(files: DataFrame, contract_tokens: Column) -> DataFrame:
    """(mode, tokens, saving) of four ways to hand files over: source, header and contract, none, full; one pass over the files."""
    sums = files.agg(F.sum(tokens_gpt(F.col("text"))).alias("source"), F.sum(contract_tokens).alias("header"))
    none, full = F.ceil(F.lit(0.6).cast("decimal(2,1)") * F.col("header")).cast("bigint"), F.col("header") + F.col("source")
    rows = sums.select("source", F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), v.cast("bigint").alias("tokens")) for m, v in (("source", F.col("source")), ("header", F.col("header")), ("none", none), ("full", full))])))
    return rows.select("mode", "tokens", F.round(100 - 100 * F.col("tokens") / F.col("source")).cast("bigint").alias("saving"))


def first_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def token_delta(old: DataFrame, new: DataFrame, key: str = "folder") -> DataFrame:
    """(key, gpt_old, gpt_new, gpt_delta, claude_old, claude_new, claude_delta, percent) of the JSON arrays that the bundles make.

    old and new hold (key, text), text being a bundle's compact JSON. A side without a key has no tokens; percent is the change
    of gpt against old, 0 where there was none. Lengths are added up, so no array is built.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        length = F.sum(F.char_length("text").cast("bigint")) + F.count(F.lit(1)) + 1  # commas between, brackets around
        made = df.groupBy(key).agg(length.alias("n"))
        return made.select(key, F.ceil(F.col("n") / 4).cast("bigint").alias(f"gpt_{name}"), F.ceil(F.col("n") / 4.5).cast("bigint").alias(f"claude_{name}"))

    both = side(old, "old").join(side(new, "new"), key, "full_outer").fillna(0, ["gpt_old", "gpt_new", "claude_old", "claude_new"])
    percent = F.when(F.col("gpt_old") > 0, F.round(100 * (F.col("gpt_new") - F.col("gpt_old")) / F.col("gpt_old"), 2)).otherwise(0.0)
    return both.select(key, "gpt_old", "gpt_new", (F.col("gpt_new") - F.col("gpt_old")).alias("gpt_delta"), "claude_old", "claude_new", (F.col("claude_new") - F.col("claude_old")).alias("claude_delta"), percent.alias("percent"))
