"""Canonical JSON of columns of any type, and collated order; both are made from the column's schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.char_length(whole) - 2)


def _members(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def canonical_json(value: Column, kind: T.DataType, sort_strings: bool = True) -> Column:
    """JSON text that does not depend on the order of what has none: fields and map keys are sorted, at any depth.

    Arrays of strings are sorted too unless sort_strings is false; other arrays keep their order. Null fields and null values
    of maps are left out, null elements of arrays are null; a null value gives null.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        pairs = [F.concat(F.lit(_quoted(f.name) + ":"), canonical_json(value[f.name], f.dataType, sort_strings)) for f in fields]
        return F.when(value.isNotNull(), _members(F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.alias("k"), canonical_json(value[k], kind.valueType, sort_strings).alias("v"))))
        return _members(F.transform(F.filter(entries, lambda e: e["v"].isNotNull()), lambda e: F.concat(json_string(e["k"].cast("string")), F.lit(":"), e["v"])))
    if isinstance(kind, T.ArrayType):
        items = F.array_sort(value) if sort_strings and isinstance(kind.elementType, T.StringType) else value
        texts = F.transform(items, lambda x: F.coalesce(canonical_json(x, kind.elementType, sort_strings), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("string")
    return F.when(value.isNotNull(), json_string(value.cast("string")))


def _quoted(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def record(items: Column, key: Column | str, text) -> Column:
    """A JSON object from an array: text(item), which is JSON already, under each item's name; keys sorted, the last of a name counts."""
    names = F.array_sort(F.array_distinct(F.transform(items, lambda x: x[key])))
    last = lambda n: F.element_at(F.filter(items, lambda x: x[key] == n), -1)
    return F.when(items.isNotNull(), _members(F.transform(names, lambda n: F.concat(json_string(n), F.lit(":"), text(last(n))))))


def collated(text: Column) -> Column:
    """text ordered as a reader expects: letters before their case and accents, by the root collation."""
    return F.collate(text, "UNICODE")


def sorted_by_name(items: Column, name) -> Column:
    """An array in the collated order of name(item); ties by the binary order of the name."""
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(collated(name(x)).alias("c"), name(x).alias("b"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])
