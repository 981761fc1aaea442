"""Lexical views of source text, as column expressions that read a text once from left to right.

Patterns are possessive: the regular expression engine neither backtracks into what it has read nor recurses by its length,
so that literals and bodies of any size run. Source gives four views of a text: ``code`` (without comments), ``bare`` (code
with empty strings), ``flat`` (bare with empty brackets: what stands at depth zero) and ``statements`` (flat, cut).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 24  # brackets within brackets that count as one; deeper ones are read from their inner levels
GENERICS = 8  # the same for type arguments
TEMPLATES = 3  # templates within the expressions of templates


def _quoted(q: str) -> str:
    return rf"{q}[^{q}\\\n]*+(?:\\[\s\S][^{q}\\\n]*+)*+{q}"


DOUBLE, SINGLE = _quoted('"'), _quoted("'")
PLAIN_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"


def _template(depth: int) -> str:
    inner = _template(depth - 1) if depth else PLAIN_TEMPLATE
    braces = r"\{[^{}`]*+\}"
    return rf"`[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{{)|\$\{{(?:[^{{}}`'\"]++|{DOUBLE}|{SINGLE}|{inner}|{braces}|['\"])*+\}})[^`\\$]*+)*+`"


TEMPLATE = _template(TEMPLATES)
STRING = rf"{DOUBLE}|{SINGLE}|{TEMPLATE}|{PLAIN_TEMPLATE}"
COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?+|//[^\n]*+"
REGEX = r"(?<=[(,=:\[!&|?{;]\s{0,4})/(?![*/\s])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
WORD = r"[\w$]"


def _nest(depth: int, strings: bool) -> str:
    """A bracket of any kind, what is in it and its end."""
    text, more = (r"[^()\[\]{}'\"`]++", rf"|{DOUBLE}|{SINGLE}|{PLAIN_TEMPLATE}|['\"`]") if strings else (r"[^()\[\]{}]++", "")
    out = rf"[(\[{{](?:{text}{more})*+[)\]}}]"
    for _ in range(depth):
        out = rf"[(\[{{](?:{text}{more}|{out})*+[)\]}}]"
    return out


def _generic(depth: int) -> str:
    out = rf"<(?:[^<>()\[\]{{}}=;]++|=>?+|{_nest(6, False)})*+>"
    for _ in range(depth):
        out = rf"<(?:[^<>()\[\]{{}}=;]++|=>?+|{_nest(6, False)}|{out})*+>"
    return out


NEST, NEST_CODE, GENERIC = _nest(DEPTH, False), _nest(DEPTH, True), _generic(GENERICS)
_STARTS = r"export|import|function|async|const|let|var|class|interface|type|enum|abstract|declare|@"


def without_comments(text: Column) -> Column:
    """Strings and regular expressions stay as they are, comments become nothing."""
    return F.regexp_replace(text, rf"({STRING}|{REGEX})|{COMMENT}", "$1")


def without_strings(code: Column) -> Column:
    """Strings and regular expressions become empty strings."""
    return F.regexp_replace(code, rf"{STRING}|{REGEX}", '""')


def at_depth_zero(bare: Column) -> Column:
    """Brackets lose what is in them."""
    body = r"(?:[^()\[\]{}]++|" + _nest(DEPTH - 1, False) + ")*+"
    return F.regexp_replace(bare, rf"([(\[{{]){body}([)\]}}])", "$1$2")


def statements(flat: Column) -> Column:
    """The statements at depth zero: cut at semicolons, line ends that no operator bridges, and after a block before a declaration."""
    joined = F.regexp_replace(flat, r"(?<=[,=|&?:+<>(])[ \t]*+\r?\n\s*+|\s*+\n\s*+(?=[,|&?:.=+])", " ")
    cut = F.split(joined, rf"[;\n]|(?<=\}})\s*+(?=(?:{_STARTS})\b)")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s++|\s++$", "")), lambda s: s != "")


def pieces(text: Column, separators: str = ",") -> Column:
    """Cut at separators outside brackets, type arguments and strings; a line break before | or & does not separate."""
    stop = separators.replace("\n", r"\n")
    return F.regexp_extract_all(
        text, F.lit(rf"((?:[^{stop}()\[\]{{}}<>'\"`=]++|{DOUBLE}|{SINGLE}|{PLAIN_TEMPLATE}|=>?+|{NEST_CODE}|{GENERIC}|\n(?=\s*[|&])|(?<=[|&:]\s{{0,9}})\n|[<>'\"`])++)"), F.lit(1)
    )


def inside(bracketed: Column) -> Column:
    """A bracket's content."""
    return F.substring(bracketed, F.lit(2), F.greatest(F.char_length(bracketed) - 2, F.lit(0)))


@dataclass(frozen=True)
class Source:
    """Views of one text column."""

    text: Column
    code: Column
    bare: Column
    flat: Column
    statements: Column

    @staticmethod
    def of(text: Column | Source) -> Source:
        if isinstance(text, Source):
            return text
        code = without_comments(text)
        bare = without_strings(code)
        flat = at_depth_zero(bare)
        return Source(text, code, bare, flat, statements(flat))


VIEWS = ("_code", "_bare", "_flat", "_statements")


def scanned(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, Source]:
    """df plus the views as columns that are made once for each row, and a Source of them.

    They come from a generator, which the optimizer does not merge into the expressions that use them.
    """
    text = F.col(text_col)
    views = [lambda d: without_comments(text), lambda d: without_strings(F.col("_code")), lambda d: at_depth_zero(F.col("_bare")), lambda d: statements(F.col("_flat"))]
    made = reduce(lambda d, kv: d.select("*", F.explode(F.array(kv[1](d))).alias(kv[0])), zip(VIEWS, views), df.drop(*VIEWS))
    return made, Source(text, *[F.col(v) for v in VIEWS])
