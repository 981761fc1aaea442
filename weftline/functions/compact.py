"""A compact text form of nested values: objects as lines, arrays of scalars in one line, uniform arrays as a header and rows.

encode() is compiled from a schema into column expressions. A string stands without quotes where nothing else could be meant;
null fields are left out. decode() gives back the value that was encoded: a small parser turns a text into JSON.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.canonical import json_string

NONE = "~"  # a null row of a table
_KEY = r"^[A-Za-z_$][\w$.]*$"
_QUOTED = r"(?s)^$|^(?:true|false|null|~|NaN|-?Infinity)$|^[-+]?[\d.]++(?:[eE][-+]?\d++)?$|^-|^\s|\s$|[\",:\\\[\]{}\p{Cntrl}]"


def _key(name: Column) -> Column:
    return F.when(name.rlike(_KEY), name).otherwise(json_string(name))


def _field(name: str) -> str:
    return name if re.fullmatch(_KEY[1:-1], name) else json.dumps(name, ensure_ascii=False)


def _is_scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.MapType, T.ArrayType))


def _scalar(value: Column, kind: T.DataType) -> Column:
    text = value.cast("string")
    shown = text if isinstance(kind, (T.NumericType, T.BooleanType)) else F.when(text.rlike(_QUOTED), json_string(text)).otherwise(text)
    return F.coalesce(shown, F.lit("null"))


def _indented(lines: Column) -> Column:
    return F.transform(lines, lambda s: F.concat(F.lit("  "), s))


def _fields(value: Column, kind: T.DataType) -> Column:
    """The lines of an object's fields, one after another."""
    if isinstance(kind, T.MapType):
        return F.flatten(F.transform(F.map_entries(value), lambda e: _entry(_key(e["key"].cast("string")), e["value"], kind.valueType)))
    parts = [_entry(F.lit(_field(f.name)), value[f.name], f.dataType) for f in kind.fields]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _item(value: Column, kind: T.DataType) -> Column:
    """The lines of an element of a list: its first line after a dash, the others below."""
    if _is_scalar(kind):
        lines = F.array(_scalar(value, kind))
    elif isinstance(kind, T.ArrayType):
        lines = F.coalesce(_array(F.lit(""), value, kind), F.array(F.lit("null")))
    else:
        inner = _fields(value, kind)
        lines = F.when(value.isNull(), F.array(F.lit("null"))).when(F.size(inner) == 0, F.array(F.lit(""))).otherwise(inner)
    return F.transform(lines, lambda s, k: F.concat(F.when(k == 0, "- ").otherwise("  "), s))


def _array(key: Column, value: Column, kind: T.ArrayType) -> Column:
    of, n = kind.elementType, F.concat(key, F.lit("["), F.size(value).cast("string"), F.lit("]"))
    if _is_scalar(of):
        row = F.array_join(F.transform(value, lambda x: _scalar(x, of)), ",")
        lines = F.array(F.concat(n, F.lit(":"), F.when(F.size(value) > 0, F.concat(F.lit(" "), row)).otherwise("")))
    elif isinstance(of, T.StructType) and of.fields and all(_is_scalar(f.dataType) for f in of.fields):
        head = F.concat(n, F.lit("{" + ",".join(_field(f.name) for f in of.fields) + "}:"))
        rows = F.transform(value, lambda x: F.when(x.isNull(), NONE).otherwise(F.concat_ws(",", *[_scalar(x[f.name], f.dataType) for f in of.fields])))
        lines = F.concat(F.array(head), _indented(rows))
    else:
        lines = F.concat(F.array(F.concat(n, F.lit(":"))), _indented(F.flatten(F.transform(value, lambda x: _item(x, of)))))
    return F.when(value.isNotNull(), lines)


def _entry(key: Column, value: Column, kind: T.DataType) -> Column:
    """The lines of a field; none for null."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(_array(key, value, kind), none)
    if _is_scalar(kind):
        return F.when(value.isNull(), none).otherwise(F.array(F.concat(key, F.lit(": "), _scalar(value, kind))))
    return F.when(value.isNull(), none).otherwise(F.concat(F.array(F.concat(key, F.lit(":"))), _indented(_fields(value, kind))))


def encode(value: Column, kind: T.StructType | T.MapType) -> Column:
    """The compact text of a struct or map."""
    return F.when(value.isNotNull(), F.array_join(_fields(value, kind), "\n"))


# ---- reading ----------------------------------------------------------------------------------------------------------

_HEAD = re.compile(r'(?P<key>"(?:[^"\\]|\\.)*"|[^\[\]{}:",\s]*)(?:\[(?P<n>\d+)\](?:\{(?P<fields>(?:"(?:[^"\\]|\\.)*"|[^"}])*)\})?)?:(?: (?P<value>.*))?$', re.S)
_CELL = re.compile(r'"(?:[^"\\]|\\.)*"|[^,]+')
_NUMBER = re.compile(r"[-+]?[\d.]+(?:[eE][-+]?\d+)?")
_PLAIN = frozenset(("true", "false", "null", "NaN", "Infinity", "-Infinity"))
_NUMERIC = frozenset("+-.0123456789")
_dump = json.JSONEncoder().encode


@lru_cache(4096)
def _text(cell: str) -> str:
    return cell if cell.startswith('"') or cell in _PLAIN else _dump(cell)


def _value(cell: str) -> str:
    """A cell as JSON: literals and numbers as they were read, other text quoted."""
    return cell if cell[:1] in _NUMERIC and _NUMBER.fullmatch(cell) else _text(cell)


@lru_cache(4096)
def _name(key: str) -> str:
    """A key as JSON with its colon."""
    return _dump(json.loads(key) if key.startswith('"') else key) + ":"


@lru_cache(4096)
def _names(fields: str) -> tuple[str, ...]:
    return tuple(map(_name, _CELL.findall(fields)))


def _parse(lines: list[str], at: int, deep: int) -> tuple[str, int]:
    """An object's fields from line at on as JSON, and the line after them; of a key that repeats the last value counts."""
    out: dict = {}
    while at < len(lines) and lines[at].startswith(" " * deep):
        m = _HEAD.match(lines[at][deep:])
        value, at = _parse_after(lines, at, deep, m)
        out[_name(m["key"])] = value
    return "{" + ",".join([k + v for k, v in out.items()]) + "}", at


def _parse_after(lines: list[str], at: int, deep: int, m: re.Match) -> tuple[str, int]:
    """The value of a field or header whose first line is at, as JSON: what follows its colon and the lines below it."""
    if m["n"] is None:
        if m["value"] is not None:
            return _value(m["value"]), at + 1
        return _parse(lines, at + 1, deep + 2)
    n, at = int(m["n"]), at + 1
    if m["fields"] is not None:
        names, rows = _names(m["fields"]), []
        for row in lines[at : at + n]:
            row = row[deep + 2 :]
            rows.append("null" if row == NONE else "{" + ",".join([k + _value(c) for k, c in zip(names, _CELL.findall(row))]) + "}")
        return "[" + ",".join(rows) + "]", at + n
    if m["value"] is not None or n == 0:
        return "[" + ",".join(map(_value, _CELL.findall(m["value"] or ""))) + "]", at
    items = []
    for _ in range(n):
        first = lines[at][deep + 4 :]
        head = _HEAD.match(first)
        if first == "":
            value, at = "{}", at + 1
        elif head is None or first.startswith('"') and json_end(first) == len(first):
            value, at = _value(first), at + 1
        elif head["key"] == "" and head["n"] is not None:
            value, at = _parse_after(lines, at, deep + 4, head)
        else:
            lines[at] = " " * (deep + 4) + first
            value, at = _parse(lines, at, deep + 4)
        items.append(value)
    return "[" + ",".join(items) + "]", at


def json_end(text: str) -> int:
    """Where a string literal that begins a text ends."""
    return re.match(r'"(?:[^"\\]|\\.)*"', text).end()


def to_json_text(text: str) -> str:
    return _parse(text.split("\n") if text else [], 0, 0)[0]


def decode(text: Column, schema: T.StructType | str) -> Column:
    """The struct that encode() made a text of."""

    @F.udf("string", useArrow=True)
    def read(s):
        return None if s is None else to_json_text(s)

    return F.from_json(read(text), schema)
