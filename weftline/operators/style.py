"""Style facets of source text: utility classes and their categories, breakpoints, layout, looks, style sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import normalize, parent
from weftline.operators.extract import Text, _all, _or_null, _part, imports, sorted_set
from weftline.operators.lexer import NEST_CODE, PLAIN_TEMPLATE, STRING, VIEWS, Source, inside, pieces, scanned, without_comments

# Class categories in order, first match wins.
CATEGORIES = [
    ("layout", r"^(flex|flex-|grid|grid-cols-|grid-rows-|col-|col-span-|row-|row-span-|block|inline|hidden|container|box-|aspect-|columns-|break-|table|inline-table|table-caption|table-cell|table-column|table-column-group|table-footer-group|table-header-group|table-row-group|table-row|flow-root|contents|list-item|items-|justify-|content-|self-|place-|order-|grow|shrink|basis-)"),
    ("spacing", r"^(p-|m-|px-|py-|mx-|my-|pt-|pb-|pl-|pr-|mt-|mb-|ml-|mr-|space-|gap-)"),
    ("sizing", r"^(w-|h-|min-w-|min-h-|max-w-|max-h-|size-)"),
    ("positioning", r"^(static|fixed|absolute|relative|sticky|inset-|top-|right-|bottom-|left-|z-)"),
    ("borders", r"^(border-|rounded|rounded-|ring-|ring-offset-|divide-|outline-)"),
    ("colors", r"^(bg-|text-(?:black|white|slate|gray|zinc|neutral|stone|red|orange|amber|yellow|lime|green|emerald|teal|cyan|sky|blue|indigo|violet|purple|fuchsia|pink|rose)(?:-|$)|text-\[[^\]]+\]|from-|via-|to-|decoration-|accent-|caret-)"),
    ("typography", r"^(font-|leading-|tracking-|antialiased|subpixel|italic|not-italic|uppercase|lowercase|capitalize|normal-case|truncate|whitespace-|line-clamp-|indent-|align-|vertical-align-|text-)"),
    ("effects", r"^(shadow-|opacity-|mix-|backdrop-|blur-|brightness-|contrast-|grayscale|hue-|invert|saturate|sepia)"),
    ("transitions", r"^(transition-|duration-|ease-|delay-|animate-)"),
    ("transforms", r"^(scale-|rotate-|translate-|skew-|origin-)"),
    ("interactivity", r"^(cursor-|select-|pointer-events-|resize-|scroll-|touch-|will-)"),
    ("overflow", r"^(overflow-|overscroll-)"),
    ("display", r"^(object-|float-|clear-|isolate)"),
    ("svg", r"^(fill-|stroke-)"),
]
# Variant prefixes, and those that are breakpoints.
VARIANTS = r"^(?:(sm|md|lg|xl|2xl|max-sm|max-md|max-lg|max-xl|max-2xl|hover|focus|focus-visible|focus-within|active|disabled|visited|first|last|odd|even|group-hover|group-focus|group-focus-visible|group-active|peer-hover|peer-focus|peer-focus-visible|peer-active|peer-checked|peer-disabled|dark|light|motion-safe|motion-reduce|open|checked|selected|indeterminate|required|optional|valid|invalid|in-range|out-of-range|read-only|read-write|empty|target|before|after|placeholder|file|marker|selection|first-line|first-letter|backdrop|print|aria-[^:]+|data-[^:]+|aria-expanded|aria-pressed|aria-selected|aria-hidden|aria-disabled|supports-\[[^\]]+\]|has-\[[^\]]+\]|\[[^\]]+\]|@[^:]+):)+"
BREAKPOINTS = r"\b(@?sm|@?md|@?lg|@?xl|@?2xl|@?max-sm|@?max-md|@?max-lg|@?max-xl|@?max-2xl|@[a-zA-Z0-9_-]+):"
TOP_CLASSES = 15


# What a class expression is reduced to: § and a number stand for a string, ∅ for a value without classes.
CALLS = ("cn", "clsx", "classnames")
_SPAN = rf"\$\{{(?:[^{{}}`'\"]++|{PLAIN_TEMPLATE}|\"[^\"\n]*+\"|'[^'\n]*+'|\{{[^{{}}]*+\}})*+\}}"
_PAREN = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"
_OPERAND = rf"(?:[!+~-]\s*+)*+(?:§\d++§|∅|[\w$.]++|{_PAREN})"
ITEM = "struct<key:string,expr:string>"


def _words(text: Text) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.contains("${") & ~w.contains("}"))


def _place(key: Column, at: Column) -> Column:
    return F.concat(key, F.lit("."), F.lpad(at.cast("string"), 7, "0"))


def _values(expr: Column) -> Column:
    """An expression whose strings are numbered, reduced to what can be its value: literals and names, the branches of ?:,
    the sides of && || ??, the arguments of CALLS; not conditions, comparisons, other calls, objects and arrays."""
    steps = [
        (r"\?\?", "||"), (r"\?\.(?=[\w$])", "."), (r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}|\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\]", "∅"),
        (rf"(?<![\w$.])(?!(?:{'|'.join(CALLS)})\b)[\w$]++(?:\.[\w$]++|∅)*+\s*+{_PAREN}|(?<=\.)[\w$]++\s*+{_PAREN}", "∅"), (rf"(?<![\w$.])(?:{'|'.join(CALLS)})\s*+\(", "("),
        (rf"{_OPERAND}(?:\s*+(?:[=!]==?|[<>]=?|[*/%+-])\s*+{_OPERAND})++", "∅"), (rf"!+\s*+{_OPERAND}|\btypeof\s++{_OPERAND}", "∅"),
        (rf"(?:[^(),?:]++|{_PAREN})*+\?", "?"),
    ]
    return reduce(lambda e, s: F.regexp_replace(e, *s), steps, expr)


def _read(item: Column) -> Column:
    """(key, kind, text) of one expression: words of its strings, the expressions in its templates, the names it refers to."""
    strings = F.regexp_extract_all(item["expr"], F.lit(f"({STRING})"), F.lit(1))
    around = F.split(item["expr"], STRING)
    numbered = F.array_join(F.transform(around, lambda a, k: F.concat(a, F.when(k < F.size(strings), F.concat(F.lit("§"), k.cast("string"), F.lit("§"))).otherwise(""))), "")
    atoms = F.regexp_extract_all(_values(numbered), F.lit(r"(§\d+§|(?<![\w$.])[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)?+(?![\w$.(]))"), F.lit(1))
    entry = lambda key, kind, text: F.struct(key.alias("key"), F.lit(kind).alias("kind"), text.alias("text"))

    def literal(key: Column, s: Column) -> Column:
        body = inside(s)
        fixed = F.transform(F.split(body, _SPAN), lambda x, n: F.transform(_words(x), lambda w: entry(_place(key, 2 * n), "class", w)))
        spans = F.transform(F.regexp_extract_all(body, F.lit(f"({_SPAN})"), F.lit(1)), lambda x, n: entry(_place(key, 2 * n + 1), "expr", F.substring(x, F.lit(3), F.char_length(x) - 3)))
        plain = F.transform(F.filter(F.split(body, r"\s+"), lambda w: w != ""), lambda w: entry(_place(key, F.lit(0)), "class", w))
        return F.when(s.startswith("`"), F.concat(F.flatten(fixed), spans)).otherwise(plain)

    def atom(a: Column, n: Column) -> Column:
        key = _place(item["key"], n)
        return F.when(a.startswith("§"), literal(key, F.get(strings, F.regexp_extract(a, r"(\d+)", 1).cast("int")))).otherwise(F.array(entry(key, "name", a)))

    return F.flatten(F.transform(atoms, atom))


def constants(text: Text) -> Column:
    """name, expr of const, let and var declarations anywhere in a file, and of the members of those that hold an object (as name.member)."""
    code = Source.of(text).code
    value = rf"((?:[^;\n,()\[\]{{}}'\"`]++|{STRING}|{NEST_CODE}|\n(?=\s*+[?:|&.])|(?<=[=?:|&]\s{{0,99}})\n)++)"
    found = _all(code, rf"\b((?:const|let|var)\s++[\w$]++\s*+(?::[^=;\n]++)?+=(?![=>])\s*+{value})")
    name, rest = (lambda f: _part(f, r"^\w+\s+([\w$]+)")), (lambda f: F.regexp_replace(f, r"^\w++\s++[\w$]++\s*+(?::[^=;\n]++)?+=\s*+", ""))
    whole = F.transform(found, lambda f: F.struct(name(f).alias("name"), rest(f).alias("expr")))
    member = rf"(?s)^\s*+(?:[\"']?([\w$-]++)[\"']?)\s*+:\s*+(.+)$"
    held = F.filter(whole, lambda c: c["expr"].startswith("{"))
    parts = F.flatten(F.transform(held, lambda c: F.transform(F.filter(pieces(inside(_part(c["expr"], f"^({NEST_CODE})"))), lambda m: m.rlike(member)), lambda m: F.struct(F.concat(c["name"], F.lit("."), _part(m, member, 1)).alias("name"), _part(m, member, 2).alias("expr")))))
    return F.concat(whole, parts)


def classes(text: Text) -> Column:
    """Distinct class names of className and class attributes, in order of appearance.

    Values are strings, templates and expressions in braces; a name stands for the constant of the file it is declared as, a
    member for that of its object, and so on. A name is followed once, so that constants may refer to each other.
    """
    src = Source.of(text)
    attribute = rf"(?<![\w$.-])(?:className|class)\s*+=\s*+(?:{STRING}|(?=\{{){NEST_CODE})"
    seen = F.filter(_all(src.code, rf"({attribute}|{STRING})"), lambda g: g.startswith("class"))  # attributes in strings are none
    given = F.transform(seen, lambda g: F.regexp_replace(g, r"^\w++\s*+=\s*+", ""))
    start = F.transform(given, lambda g, n: F.struct(F.lpad(n.cast("string"), 7, "0").alias("key"), F.when(g.startswith("{"), inside(g)).otherwise(g).alias("expr")))
    known = F.when(F.size(given) > 0, constants(src))
    rounds = F.when(F.size(given) > 0, F.sequence(F.lit(0), F.size(known) + F.size(F.split(src.code, r"\$\{")))).otherwise(F.array(F.lit(0)))
    empty = F.struct(start.cast(f"array<{ITEM}>").alias("due"), F.array().cast("array<struct<key:string,text:string>>").alias("found"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, _: Column) -> Column:
        read = F.flatten(F.transform(acc["due"], _read))
        names = F.filter(read, lambda r: (r["kind"] == "name") & ~F.array_contains(acc["seen"], r["text"]))
        held = lambda r: F.get(F.filter(known, lambda c: c["name"] == r["text"]), F.lit(0))["expr"]
        more = F.concat(F.transform(names, lambda r: F.struct(r["key"].alias("key"), held(r).alias("expr"))), F.transform(F.filter(read, lambda r: r["kind"] == "expr"), lambda r: F.struct(r["key"].alias("key"), r["text"].alias("expr"))))
        found = F.transform(F.filter(read, lambda r: r["kind"] == "class"), lambda r: F.struct(r["key"].alias("key"), r["text"].alias("text")))
        after = F.struct(F.filter(more, lambda m: m["expr"].isNotNull()).alias("due"), F.concat(acc["found"], found).alias("found"), F.array_union(acc["seen"], F.transform(names, lambda r: r["text"])).alias("seen"))
        return F.when(F.size(acc["due"]) == 0, acc).otherwise(after)

    found = F.aggregate(rounds, empty, step)["found"]
    inner = F.transform(found, lambda f, n: F.struct(f["key"].alias("key"), n.alias("n"), f["text"].alias("text")))
    return F.array_distinct(F.transform(F.array_sort(inner), lambda f: f["text"]))


def strip_variants(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, VARIANTS, ""), "^!", "")


def class_category(name: Column) -> Column:
    """Category of a class name after its variants are stripped."""
    base = strip_variants(name)
    return reduce(lambda c, kv: c.when(base.rlike(kv[1]), kv[0]), CATEGORIES, F).otherwise("other")


def breakpoints(names: Column) -> Column:
    return sorted_set(F.flatten(F.transform(names, lambda c: _all(c, BREAKPOINTS))))


def by_category(rows: DataFrame, key: str, name: str = "class") -> DataFrame:
    """(key, class) rows to (key, category, classes): the first TOP_CLASSES of the sorted distinct classes, and how many there are."""
    each = rows.select(key, class_category(F.col(name)).alias("category"), F.col(name).alias("c")).distinct()
    rank = Window.partitionBy(key, "category").orderBy("c")
    top = each.withColumns({"r": F.row_number().over(rank), "n": F.count(F.lit(1)).over(Window.partitionBy(key, "category"))}).where(F.col("r") <= TOP_CLASSES)
    return top.groupBy(key, "category").agg(F.array_sort(F.collect_list("c")).alias("classes"), F.first("n").alias("n"))


def _core(names: Column) -> Column:
    return F.transform(names, lambda c: F.element_at(F.split(c, ":"), -1))


def layout(names: Column, text: Text) -> Column:
    """type (grid before flex), cols, hero (very large text and a button) and cards (a grid of rounded or shadowed boxes)."""
    core = _core(names)
    some = lambda p: F.exists(core, lambda c: c.rlike(p))
    cols = F.filter(F.transform(names, lambda c: _part(c, r"grid-cols-(\d+)")), lambda c: c != "")
    return F.struct(
        F.when(some("^grid"), "grid").when(some("^flex"), "flex").alias("type"), F.when(some("^grid"), _or_null(F.array_join(cols, " "))).alias("cols"),
        (some("^text-[4-9]xl$") & Source.of(text).code.rlike(r"(?i)<button[\s/>]")).alias("hero"), (some("^grid") & some("card|rounded|shadow")).alias("cards"),
    )


def visual(names: Column) -> Column:
    """Ten first colours, spacings and type classes, and the most frequent radius (ties by name)."""
    core = _core(names)
    top = lambda p: F.slice(sorted_set(F.filter(core, lambda c: c.rlike(p))), 1, 10)
    radii = F.transform(F.filter(core, lambda c: c.rlike("^rounded")), lambda c: F.coalesce(_or_null(_part(c, r"^rounded-(\w+)")), F.lit("default")))
    counted = F.transform(F.array_distinct(radii), lambda r: F.struct((-F.size(F.filter(radii, lambda x: x == r))).alias("n"), r.alias("r")))
    return F.struct(
        top(r"^(?:bg-|text-|border-)").alias("colors"), top(r"^-?(?:p-|m-|px-|py-|mx-|my-|pt-|pb-|pl-|pr-|mt-|mb-|ml-|mr-)[\w.\[\]]+").alias("spacing"),
        top(r"^(?:text-|font-)").alias("typography"), F.get(F.array_sort(counted), F.lit(0))["r"].alias("radius"),
    )


def inline_styles(text: Text) -> Column:
    """name, value of style={{ … }} attributes; the value only if it is a literal."""
    members = F.flatten(F.transform(_all(Source.of(text).code, r"style=\{\{([^{}]*)\}\}"), lambda b: _all(b, r"([\w'\"-]+\s*:\s*(?:\"[^\"]*\"|'[^']*'|[^,]+))")))
    name = lambda m: F.regexp_replace(_part(m, r"^([\w'\"-]+)"), "['\"]", "")
    value = lambda m: F.trim(_part(m, r":\s*(.*)$"))
    literal = lambda m: F.when(value(m).rlike(r"^(?:\"[^\"]*\"|'[^']*'|-?\d+(?:\.\d+)?)$"), F.regexp_replace(value(m), "^['\"]|['\"]$", ""))
    return F.array_sort(F.transform(members, lambda m: F.struct(name(m).alias("name"), literal(m).alias("value"))))


def css_details(css: Column) -> Column:
    """Twenty first selectors and properties of a style sheet, and which features it has."""
    plain = F.regexp_replace(css, r"(?s)/\*.*?\*/|(?<!:)//[^\n]*", "")
    selectors = F.transform(_all(plain, r"(?:^|[{};])\s*([^{};@]+?)\s*\{"), F.trim)
    return F.struct(
        F.slice(sorted_set(F.filter(selectors, lambda s: s != "")), 1, 20).alias("selectors"), F.slice(sorted_set(_all(plain, r"(?:^|[{};])\s*([a-z-]+)\s*:[^;{}]*(?=[;}])")), 1, 20).alias("properties"),
        plain.rlike(r"\$[\w-]+\s*:").alias("has_variables"), plain.rlike(r"&[:.\s-]").alias("has_nesting"), plain.contains("@mixin").alias("has_mixins"),
        plain.contains("@media").alias("has_media"), plain.contains("@keyframes").alias("has_keyframes"),
    )


def styled_jsx(text: Text) -> Column:
    """css, global and the parsed details of a <style jsx> block; null without one."""
    block = _part(Source.of(text).text, r"(?s)(<style\s+jsx[^>]*>\s*\{`.*?`\}\s*</style>)")
    css = _part(block, r"(?s)\{`(.*?)`\}")
    return F.when(block != "", F.struct(F.trim(css).alias("css"), block.rlike(r"^<style\s+jsx\s+global").alias("global"), css_details(css).alias("details")))


def styled_components(text: Text) -> Column:
    """Ten first styled tags, whether a theme is used and whether the css prop is."""
    code = Source.of(text).code
    return F.struct(F.slice(sorted_set(_all(code, r"\bstyled[.(]\s*['\"]?(\w+)")), 1, 10).alias("tags"), code.rlike(r"props\.theme|\btheme\s*[.}]|useTheme\s*\(").alias("theme"), code.rlike(r"\scss=\{").alias("css_prop"))


def motion(text: Text) -> Column:
    """Animated tags and which kinds of animation attributes they have."""
    code = Source.of(text).code
    return F.struct(
        sorted_set(_all(code, r"<motion\.(\w+)")).alias("tags"), sorted_set(_all(code, r"variants=\{(\w+)\}")).alias("variants"), code.rlike(r"\swhile(?:Hover|Tap|Focus|Drag)=").alias("gestures"),
        code.rlike(r"\slayout(?:Id)?[=\s/>]").alias("layout"), code.rlike(r"\s(?:whileInView|viewport)=").alias("viewport"),
    )


def animation(text: Text, names: Column) -> Column:
    """library, type and trigger of a file's animation, first rule that fits; null without any."""
    code, core = Source.of(text).code, _core(names)
    uses_motion, css = code.rlike(r"<motion\."), F.exists(core, lambda c: c.rlike("^(?:animate-|transition)"))
    trigger = F.when(code.rlike(r"whileInView="), "inView").when(code.rlike(r"whileHover="), "hover").when(uses_motion, "mount").otherwise("class")
    kind = F.when(code.rlike(r"opacity\s*:"), "fade").when(code.rlike(r"\b[xy]\s*:"), "slide").when(code.rlike(r"scale\s*:"), "scale").otherwise("custom")
    return F.when(uses_motion, F.struct(F.lit("motion").alias("library"), kind.alias("type"), trigger.alias("trigger"))).when(css, F.struct(F.lit("css").alias("library"), F.lit("transition").alias("type"), F.lit("class").alias("trigger")))


def library_components(text: Text, module: str) -> Column:
    """local name, original name of the names imported from modules that match, so that uses can be counted by original name."""
    code = Source.of(text).code
    heads = _all(code, rf"(import\s*\{{[^}}]*\}}\s*from\s*['\"]{module}['\"])")
    names = F.flatten(F.transform(heads, lambda h: F.split(_part(h, r"\{([^}]*)\}"), ",")))
    each = F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.struct(F.coalesce(_or_null(_part(n, r"\bas\s+(\w+)")), _part(n, r"(\w+)")).alias("local"), _part(n, r"(\w+)").alias("original")))
    return F.array_distinct(each)


def ui_usage(sources: DataFrame, key: str, module: str, top: int) -> DataFrame:
    """(key, component, n, rank): tags of components imported from a UI library, aliases resolved, the most used first."""
    known = sources.select(key, F.inline(library_components(F.col("text"), module)))
    used = sources.select(key, F.explode(_all(without_comments(F.col("text")), r"<([A-Z]\w*)(?=[\s/>])")).alias("local"))
    n = used.join(known, [key, "local"]).groupBy(key, F.col("original").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "component"))).where(F.col("rank") <= top)


def ui_features(text: Text) -> Column:
    """Variants, sizes, controlled or not, portals and asChild of UI primitives."""
    code = Source.of(text).code
    return F.struct(
        sorted_set(_all(code, r"\bvariant=[\"'](\w+)[\"']")).alias("variants"), sorted_set(_all(code, r"\bsize=[\"'](\w+)[\"']")).alias("sizes"),
        F.when(code.rlike(r"\s(?:open|value|checked)=\{"), "controlled").when(code.rlike(r"\sdefault(?:Open|Value|Checked)="), "uncontrolled").alias("mode"),
        F.size(_all(code, r"(<\w*\.?Portal[\s/>])")).alias("portals"), F.size(_all(code, r"(\sasChild)")).alias("as_child"),
    )


def density(n: Column) -> Column:
    return F.when(n <= 3, "low").when(n <= 8, "medium").otherwise("high")


def depth(n: Column, portals: Column) -> Column:
    return F.when((n <= 3) & (portals <= 1), "simple").when((n <= 10) & (portals <= 5), "moderate").otherwise("complex")


def style(sources: DataFrame) -> DataFrame:
    """sources(path, text) to style facets; a facet is null where its system is neither imported nor used."""
    made, t = scanned(sources)
    out = made.select("*", imports(t).alias("_imports"), F.explode(F.array(classes(t))).alias("classes"))
    some = lambda p: F.exists("_imports", lambda i: i.rlike(p))
    used = F.size("classes") > 0
    sheet = F.get(F.filter("_imports", lambda i: i.rlike(r"\.(scss|css)$")), F.lit(0))
    return out.withColumns({
        "class_count": F.when(used, F.size("classes")), "breakpoints": F.when(used, breakpoints(F.col("classes"))), "layout": F.when(used, layout(F.col("classes"), t)),
        "visual": F.when(used, visual(F.col("classes"))), "inline_styles": F.when(t.code.contains("style={{"), inline_styles(t)), "style_sheet": sheet,
        "styled_jsx": styled_jsx(t), "styled": F.when(some(r"styled-components|@emotion/styled"), styled_components(t)), "motion": F.when(some(r"framer-motion|^motion"), motion(t)),
        "animation": animation(t, F.col("classes")), "ui": F.when(some(r"@mui/|@radix-ui/|components/ui"), ui_features(t)),
    }).drop("text", "_imports", *VIEWS)


def with_sheets(styles: DataFrame, sheets: DataFrame) -> DataFrame:
    """style rows (path, style_sheet) joined to the parsed style sheet that they import; sheets(path, text)."""
    beside = F.when(F.col("style_sheet").startswith("/"), F.col("style_sheet")).otherwise(F.concat(parent(F.col("path")), "style_sheet"))
    parsed = sheets.select(normalize(F.col("path")).alias("_sheet"), css_details(F.col("text")).alias("sheet"))
    return styles.withColumn("_sheet", normalize(beside)).join(parsed, "_sheet", "left").drop("_sheet")
