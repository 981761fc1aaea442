"""The compact form: round trips of any nesting and of strings that look like something else; canonical JSON."""

import json
import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import canonical, compact

SCHEMA = (
    "id string, n bigint, x double, ok boolean, tags array<string>, `odd key` string, inner struct<a:string,b:array<int>>, none struct<z:string>, "
    "rows array<struct<name:string,n:int,t:string>>, deep array<struct<id:string,parts:array<struct<k:string,v:array<string>>>>>, grid array<array<int>>, props map<string,string>, more map<string,struct<u:int>>"
)
WORDS = ["", "plain", "true", "null", "~", "007", "-1", "- x", " lead", "trail ", "a,b", "k: v", 'q"uote', "line\nbreak", "back\\slash", "[3]:", "{x}", "é漢", "\t", "NaN", "1e5", ".5", "a.b-c", "$schema"]


def rows():
    for k, w in enumerate(WORDS):
        v = WORDS[(k * 7 + 3) % len(WORDS)]
        yield (
            w, k, k / 3 if k % 4 else None, bool(k % 2), [w, None, v] if k % 3 else [], v, (w, [k, 2]) if k % 5 else None, (None,), [(w, k, v), None, (v, None, w)] if k % 2 else [],
            [(w, [(v, [w, v]), (w, [])]), None, (v, None), (None, None)] if k % 3 else None, [[1, k], [], None], {w: v, v + "x": w} if k % 4 else {}, {w: (k,), v + "y": None},
        )


def test_round_trip(spark):
    df = spark.createDataFrame(list(rows()), SCHEMA)
    whole = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("v"))
    kind = whole.schema["v"].dataType
    out = whole.select("v", compact.encode(F.col("v"), kind).alias("t")).select("v", "t", compact.decode(F.col("t"), kind).alias("w"))
    for r in out.collect():
        a, b = r["v"].asDict(True), r["w"].asDict(True)
        a["more"] = {k: x for k, x in a["more"].items() if x is not None}  # a null value is left out
        assert a == b, r["t"]
    one = out.where("v.id = 'plain'").first()["t"].split("\n")
    assert one[:4] == ["id: plain", "n: 1", "x: 0.3333333333333333", "ok: true"] and "rows[3]{name,n,t}:" in one and "  ~" in one


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=8), st.text(st.characters(codec="utf-8"), max_size=12), max_size=4))
def test_reader_takes_what_json_takes(d):
    text = "\n".join(f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}" for k, v in d.items())
    assert json.loads(compact.to_json_text(text)) == d


def test_canonical_order(spark):
    a = spark.createDataFrame([({"b": ["y", "x"], "a": None}, 1)], "m map<string,array<string>>, n int")
    b = spark.createDataFrame([({"a": None, "b": ["x", "y"]}, 1)], "m map<string,array<string>>, n int")
    texts = [df.select(canonical.canonical_json(F.struct("n", "m"), df.select(F.struct("n", "m").alias("v")).schema["v"].dataType).alias("j")).first()["j"] for df in (a, b)]
    assert texts[0] == texts[1] == '{"m":{"b":["x","y"]},"n":1}'


def test_rows_are_read_with_few_calls():
    text = "rows[1000]{part,flag,mode}:\n" + "\n".join(f'  {k},N,"O:{k}"' for k in range(1000))
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        out = compact.to_json_text(text)
    finally:
        sys.setprofile(None)
    assert json.loads(out) == {"rows": [{"part": k, "flag": "N", "mode": f"O:{k}"} for k in range(1000)]}
    assert calls[0] < 10_000
