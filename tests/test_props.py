"""A member's type is looked at once, whatever is read from it."""

from pyspark.sql import functions as F

from weftline.operators import extract as X


def test_a_type_is_made_once(spark):
    df = spark.createDataFrame([("export interface AProps {\n a: string | undefined;\n b?: 'x' | \"y\";\n c: (n: number) => void;\n d?: undefined | Foo;\n e: A || B\n}",)], "text string")
    out = df.select(X.props(F.col("text")).alias("p"))
    got = {p.name: (p.type, p.optional, p.literals, p.signature) for p in out.first().p}
    assert got == {"a": ("string", True, None, None), "b": ("literal-union", True, ["x", "y"], None), "c": ("function", None, None, "(n: number) => void"), "d": ("Foo", True, None, None), "e": ("A | B", None, None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count(r"\bundefined\b\s*\|\s*") == 1


def test_a_member_is_matched_up_to_its_type(spark):
    """The type is the rest and no pattern walks through it, which took most of the time of long interfaces."""
    df = spark.createDataFrame([("  readonly a?: { b: string };\n ",)], "m string")
    assert df.select(F.regexp_extract("m", X.MEMBER, 0).alias("h")).first().h == "  readonly a?: "
    assert df.select(F.regexp_extract(F.lit(" on?(a: string)  :\n void "), X.METHOD, 0).alias("h")).first().h == " on?(a: string)  :\n "
    text = "interface XProps { readonly a:\tA: B ; readonly: R; 'q r'?: undefinedX; $e : \n| 'x' ; f: ; g:x => y\u00a0; gone }\ntype YProps = { on?<T>(a: string)  :\n void , \"m\"(): ; k: 1 | undefined }"
    got = {p.name: (p.type, p.optional) for p in spark.createDataFrame([(text,)], "text string").select(X.props(F.col("text")).alias("p")).first().p}
    assert got == {"a": ("A: B", None), "readonly": ("R", None), "'q r'": ("undefinedX", True), "$e": ("| 'x'", None), "g": ("function", None), "on": ("function", True), "k": ("1", True)}
