"""Licence scans: Aho-Corasick over whole texts finds identifier tags and notice phrases; tagged licence expressions go
through a shunting-yard parser."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import small_batches

# Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notices.
NOTICES = {
    "bsd license": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "creative commons": "cc", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa",
    "apache license version 2 0": "apache-2.0", "general public license version 3": "gpl-3.0",
    "general public license version 2": "gpl-2.0", "public domain": "public-domain", "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
ALLOWED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "zlib"})
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def to_postfix(expression: str) -> list[str] | None:
    """Licence expression to reverse Polish order; None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand is due
    for token in _TOKEN.findall(expression.lower()):
        if token in PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                break  # text after the expression, such as the end of a comment
            out.append(token)
            operand = False
    if operand:
        return None
    while stack:
        if (top := stack.pop()) == "(":
            return None
        out.append(top)
    return out


def evaluate(postfix: list[str], allowed=ALLOWED) -> tuple[bool, frozenset[str]]:
    """(whether some choice of licences is allowed, all licence ids named); an exception after WITH is no licence."""
    stack: list[tuple[bool, frozenset[str]]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x) if token == "with" else (a and b, x | y) if token == "and" else (a or b, x | y))
        else:
            stack.append((token.rstrip("+") in allowed, frozenset({token})))
    return stack[0]


_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in {**NOTICES, **BASE, TAG: ""}:
            a.add_word(f" {phrase} ", phrase)
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def scan_text(text: str | None) -> tuple:
    words = (text or "").encode().translate(_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode()
    base: list[tuple[int, str]] = []
    labels: set[str] = set()
    hits, allowed = 0, None
    for end, phrase in _automaton().iter(line):
        hits += 1
        if phrase in BASE:
            base.append((end - len(phrase) - 1, phrase))
        elif phrase != TAG:
            labels.add(NOTICES[phrase])
        elif "tags" not in labels:
            labels.add("tags")
    if "tags" in labels:
        labels.discard("tags")
        for m in _EXPRESSION.finditer(text):
            if (postfix := to_postfix(m[1])) is not None:
                fine, ids = evaluate(postfix)
                allowed = fine if allowed is None else allowed and fine
                labels |= ids
    own = {BASE[p] for _, p in base}
    at = [line.count(" ", 0, p + 1) - 1 for p in (min(base)[0], max(base)[0])] if base else [None, None]
    return len(words), len(base), *at, ",".join(sorted(own)), ",".join(sorted(labels | own)), 1.0 - 0.5**hits, allowed


RESULT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,tags_allowed:boolean>"


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus n_words, n_base, first_word, last_word, base_labels, labels, score and tags_allowed.

    score is 1 - 2^-h for h notices and tags in the text. tags_allowed: whether every tagged expression can be met with
    allowed licences; null without a well-formed tag. A null text is empty, an empty table gives no rows, equal texts give
    equal columns, and columns of docs with these names are replaced. Texts are read whole, whatever their length; an Arrow
    batch holds a few MB of them. No shuffle; other columns stay in the JVM.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def scan(text: pa.Array) -> pa.Array:
        kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("tags_allowed", pa.bool_())])
        columns = list(zip(*(scan_text(t.as_py()) for t in text))) or [[]] * len(kind)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))

    names = [x.split(":")[0] for x in RESULT[7:-1].split(",")]
    out = docs.drop(*names, "_scan").withColumn("_scan", scan(F.col(text_col)))
    return out.select(*[c for c in out.columns if c != "_scan"], *[F.col(f"_scan.{n}").alias(n) for n in names])


def op6(spark, sf_dir: str) -> DataFrame:
    """Every document with its licence labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("text")
