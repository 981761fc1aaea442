"""Extractors that are column expressions over source text, and rules over what they extract.

Source text is read by regular expressions over the views of lexer.Source, so declared types are kept as they are written.
Every extractor takes a text column or a Source and gives an empty array, not an error, where nothing is found; a null text
gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import json_string, record
from weftline.operators.lexer import DOUBLE, GENERIC, NEST, NEST_CODE, SINGLE, VIEWS, Source, inside, pieces, scanned

Text = Column | Source
NO_CALL = ("if", "for", "while", "switch", "catch", "function", "return", "constructor")

# Names of built-in composition functions.
VUE_BUILTINS = (
    "ref", "reactive", "computed", "watch", "watchEffect", "onMounted", "onUnmounted", "onBeforeMount", "onBeforeUnmount",
    "onUpdated", "onBeforeUpdate", "onActivated", "onDeactivated", "onErrorCaptured", "onRenderTracked", "onRenderTriggered",
    "provide", "inject", "toRef", "toRefs", "isRef", "unref", "shallowRef", "triggerRef", "customRef", "shallowReactive",
    "readonly", "isReactive", "isReadonly", "toRaw", "markRaw", "effectScope", "getCurrentScope", "onScopeDispose",
    "useSlots", "useAttrs", "useCssModule", "useCssVars", "defineProps", "defineEmits", "defineExpose", "withDefaults",
)
# Runtime type constructors and the types they stand for.
VUE_TYPES = {"String": "string", "Number": "number", "Boolean": "boolean", "Array": "any[]", "Object": "object", "Function": "function", "Date": "Date"}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _or_null(text: Text) -> Column:
    return F.nullif(text, F.lit(""))


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def let(value: Column, use) -> Column:
    """use(value), with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sorted_structs(items: Column) -> Column:
    """Sorted and distinct, without comparing every pair."""
    return let(F.array_sort(items), lambda s: F.filter(s, lambda x, k: (k == 0) | ~x.eqNullSafe(F.get(s, k - 1))))


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return sorted_set(_all(text, pattern, group))


# ---- modules ----------------------------------------------------------------------------------------------------------


def imports(text: Text) -> Column:
    """Distinct module names of import declarations, sorted."""
    return all_of(Source.of(text).code, r"(?:^|[;}\n])\s*+import\b\s*+(?:[^'\";()]*?\bfrom\s*+)?['\"]([^'\"\n]+)['\"]")


ARROW = rf"^[\w$]+\s*+(?::(?:[^=;]++|=>)*+)?=(?![=>])\s*+(?:async\b\s*+)?(?:\(\)|[\w$]+)\s*+(?::(?:[^=;]++|=(?!>))*+)?=>"


def declared(text: Text) -> Column:
    """The declarators of module-level const, let and var, one text each; type arguments and what stands in brackets left out."""
    stated = F.filter(Source.of(text).statements, lambda s: s.rlike(r"^(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s"))
    plain = F.transform(stated, lambda s: F.regexp_replace(F.regexp_replace(s, r"^(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+", ""), GENERIC, ""))
    return F.transform(F.flatten(F.transform(plain, lambda s: F.split(s, ","))), lambda d: F.regexp_replace(d, r"^\s++", ""))


def functions(text: Text) -> Column:
    """Top-level functions, variables that hold an arrow function, and methods of classes anywhere."""
    src = Source.of(text)
    named = F.transform(src.statements, lambda s: _part(s, r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"))
    arrows = F.transform(F.filter(declared(src), lambda d: d.rlike(ARROW)), lambda d: _part(d, r"^(\w+)"))
    methods = _all(src.bare, rf"(?m)^[ \t]++(?:(?:public|private|protected|static|async|override)\s++)*+(\w++)\s*+(?:{GENERIC}\s*+)?+(?=\(){NEST}\s*+(?::\s*+[^{{;\n=]++(?:=>[^{{;\n=]++)*+)?+\{{")
    return sorted_set(F.concat(F.filter(F.concat(named, arrows), lambda n: n != ""), F.filter(methods, lambda m: ~m.isin(*NO_CALL))))


def exported_names(text: Text) -> Column:
    src = Source.of(text)
    exported = F.filter(src.statements, lambda s: s.rlike(r"^export\s"))
    named = F.transform(exported, lambda s: _part(s, r"^export\s+(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\b\s*\*?|class\b)\s*(\w+)"))
    several = F.transform(declared(Source(src.text, src.code, src.bare, src.flat, exported)), lambda d: _part(d, r"^(\w+)"))
    lists = F.flatten(F.transform(_all(src.bare, r"\bexport\s*+\{([^{}]*+)\}"), lambda s: F.split(s, ",")))
    listed = F.transform(lists, lambda s: _part(s, r"^\s*(?:type\s+)?(\w+)"))
    return sorted_set(F.filter(F.concat(named, several, listed), lambda n: n != ""))


def exports(text: Text) -> Column:
    """form (default, named for one name, list for more, null for none) and, for a list, the sorted names.

    A default export of a declaration outranks names; one of an expression does not count, nor do exported types.
    """
    src = Source.of(text)
    default = F.exists(src.statements, lambda s: s.rlike(r"^export\s+default\s+(?:async\s+)?(?:abstract\s+)?(?:function|class)\b"))
    names = exported_names(src)
    form = F.when(default, "default").when(F.size(names) == 1, "named").when(F.size(names) > 1, "list")
    return F.struct(form.alias("form"), F.when(form == "list", names).alias("named"))


def variables(text: Text) -> Column:
    """Names of module-level variables, without setters of a state pair; patterns that take a value apart have no name."""
    kept = F.filter(declared(text), lambda d: ~(d.rlike("^set") & d.contains("useState")))
    return sorted_set(F.filter(F.transform(kept, lambda d: _part(d, r"^(\w+)")), lambda n: n != ""))


# ---- components -------------------------------------------------------------------------------------------------------


def hooks(text: Text) -> Column:
    """Functions named use and a capital that are called, but not as a member."""
    return all_of(Source.of(text).bare, rf"(?<![\w.$])(?<!function )(use[A-Z]\w*+)\s*+(?:{GENERIC}\s*+)?+\(")


def components(text: Text) -> Column:
    """Tags that begin with a capital; dotted names are kept."""
    return all_of(Source.of(text).bare, r"(?<![\w)\]])<([A-Z][\w.]*+)(?=[\s/>])")


def has_jsx(text: Text) -> Column:
    return Source.of(text).bare.rlike(r"(?<![\w)\]])<(?:[A-Za-z][\w.]*+(?:\s[^<>]*+)?/?>|>)")


def exported_hook(text: Text) -> Column:
    """Whether a function named use and a capital is exported by its declaration or by a list."""
    src = Source.of(text)
    return F.exists(exported_names(src), lambda n: n.rlike("^use[A-Z]")) | F.exists(src.statements, lambda s: s.rlike(r"^export\s+default\s+(?:async\s+)?function\s+use[A-Z]"))


def hook_parameters(text: Text) -> Column:
    """name, type, optional of the parameters of exported hooks: the annotation, else what the default value shows, else any."""
    head = rf"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\s+use[A-Z]\w*+|const\s+use[A-Z]\w*+\s*+=\s*+(?:async\b\s*+)?)\s*+(?:{GENERIC}\s*+)?+(?=\()({NEST_CODE})"
    params = F.filter(F.flatten(F.transform(_all(Source.of(text).code, head), lambda h: pieces(inside(h)))), lambda p: F.trim(p) != "")

    def one(p: Column) -> Column:
        declared, value, rest = _or_null(F.trim(_part(p, r"(?s)^[^:=]*:\s*((?:[^=]|=>)++)"))), F.trim(_part(p, r"(?s)(?<![=<>!])=(?![=>])\s*(.+)$")), p.rlike(r"^\s*\.\.\.")
        kind = F.when(declared.isNotNull(), declared).otherwise(F.coalesce(literal_type(value), F.lit("any")))
        return F.struct(_part(p, r"^\s*(?:\.\.\.)?(\w+)").alias("name"), kind.alias("type"), ((p.rlike(r"^\s*\w+\s*\?") | (value != "")) & ~rest).alias("optional"))

    return F.transform(params, one)


def literal_type(value: Column) -> Column:
    """Type that a literal shows, else null."""
    return (
        F.when(value.isin("true", "false"), "boolean").when(value.rlike(r"^-?\d+(\.\d+)?$"), "number").when(value.rlike("^[\"'`]"), "string")
        .when(value == "null", "null").when(value.rlike(r"^\["), "array").when(value.rlike(r"^\{"), "object")
    )


def strip_undefined(kind: Column) -> Column:
    """A union type without its undefined member."""
    plain, bar = F.trim(kind), kind.contains("|")
    kind = F.regexp_replace(F.regexp_replace(kind, r"\bundefined\b\s*\|\s*", ""), r"\s*\|\s*\bundefined\b", "")
    return F.when(bar, F.trim(F.regexp_replace(kind, r"\s*\|\s*\|\s*", " | "))).otherwise(plain)


def prop_type(kind: Column, optional: Column) -> Column:
    """type, optional (null unless true), literals and signature of a declared type.

    Two or more literals in a union are a literal-union, what holds an arrow is a function, everything else its own text.
    """
    literal = r"(?:[\"'][^\"']*[\"']|0x[0-9A-Fa-f]+|-?\d+(?:\.\d+)?|true|false|null)"

    def of(kind: Column) -> Column:
        union, arrow = kind.contains("|") & kind.rlike(rf"^{literal}(?:\s*\|\s*{literal})+$"), kind.contains("=>")
        literals = F.transform(F.split(kind, r"\|"), lambda s: F.regexp_replace(F.trim(s), r"^([\"'])(.*)\1$", "$2"))
        return let(union, lambda union: F.struct(
            F.when(union, "literal-union").when(arrow, "function").otherwise(kind).alias("type"),
            F.when(optional, True).alias("optional"), F.when(union, literals).alias("literals"),
            F.when(~union & arrow, kind).alias("signature"),
        ))

    return let(strip_undefined(kind), of)  # made once for each member


# What stands before a member's type, which is the rest of it: patterns that match the rest too take ten times as long.
MEMBER = r"^\s*+(?:readonly\s+)?([\w$]++|\"[^\"\n]++\"|'[^'\n]++')(\??)\s*+:\s*+(?=\S)"
METHOD = rf"^\s*+([\w$]++|\"[^\"\n]++\"|'[^'\n]++')(\??)\s*+(?:{GENERIC})?+(?=\()({NEST_CODE})\s*+:\s*+(?=\S)"


def members(body: Column, methods: bool = False) -> Column:
    """name, type, optional of the members of a type's body; names as written, methods as arrow functions if asked for."""
    each, rest = pieces(body, ";,\n"), lambda m, head: F.rtrim(F.regexp_replace(m, head, ""))
    own = F.transform(F.filter(each, lambda m: m.rlike(MEMBER)), lambda m: F.struct(_part(m, MEMBER, 1).alias("name"), rest(m, MEMBER).alias("type"), (_part(m, MEMBER, 2) == "?").alias("optional")))
    if not methods:
        return own
    kind = lambda m: F.concat(_part(m, METHOD, 3), F.lit(" => "), rest(m, METHOD))
    return F.concat(own, F.transform(F.filter(each, lambda m: m.rlike(METHOD)), lambda m: F.struct(_part(m, METHOD, 1).alias("name"), kind(m).alias("type"), (_part(m, METHOD, 2) == "?").alias("optional"))))


def props(text: Text) -> Column:
    """name, type, optional, literals, signature of the members of interfaces and types whose name ends in Props, and of the
    parameters of exported hooks that no member has the name of; sorted.

    Methods count in types only; their names are without quotes, those in interfaces as written.
    """
    src = Source.of(text)
    bodies = lambda word: _all(src.code, rf"\b{word}\s+\w*(?i:props)\b[^{{;\n]*+(?=\{{)({NEST_CODE})")
    of_type = F.transform(F.flatten(F.transform(bodies("type"), lambda b: members(inside(b), True))), lambda m: F.struct(F.regexp_replace(m["name"], "^['\"]|['\"]$", "").alias("name"), m["type"].alias("type"), m["optional"].alias("optional")))
    own = F.concat(F.flatten(F.transform(bodies("interface"), lambda b: members(inside(b)))), of_type)
    params = hook_parameters(src)

    def one(m: Column) -> Column:
        kind = prop_type(m["type"], m["optional"] | (m["type"].contains("undefined") & m["type"].rlike(r"\bundefined\b")))
        return let(kind, lambda p: F.struct(m["name"].alias("name"), p["type"].alias("type"), p["optional"].alias("optional"), p["literals"].alias("literals"), p["signature"].alias("signature")))

    def merged(o: Column) -> Column:
        return F.concat(o, F.filter(params, lambda h: ~F.exists(o, lambda m: m["name"] == h["name"])))

    return sorted_structs(F.transform(let(own, merged), one))


def events(text: Text, own: Column) -> Column:
    """name, signature of on… attributes that are also own props; the last of a name counts.

    The signature is that of the prop, else the parameters of an arrow function given, else none.
    """
    found = F.transform(_all(Source.of(text).code, rf"\s(on[A-Z]\w*+=(?=\{{){NEST_CODE})"), lambda s: F.struct(_part(s, r"^(\w+)").alias("name"), _part(s, r"(?s)=\{(.*)\}$").alias("value")))
    names = sorted_set(F.transform(F.filter(found, lambda a: F.exists(own, lambda p: p["name"] == a["name"])), lambda a: a["name"]))

    def one(n: Column) -> Column:
        value = F.try_element_at(F.filter(found, lambda a: a["name"] == n), F.lit(-1))["value"]
        arrow = _or_null(_part(value, r"^\s*(?:async\s*)?(\([^)]*\))\s*=>"))
        prop = F.try_element_at(F.filter(own, lambda p: p["name"] == n), F.lit(-1))
        return F.struct(n.alias("name"), F.coalesce(prop["signature"], F.concat(arrow, F.lit(" => void")), F.lit("() => void")).alias("signature"))

    return F.transform(names, one)


def jsx_routes(text: Text) -> Column:
    """Literal values of link attributes that are paths, sorted."""
    found = _all(Source.of(text).code, r"\b((?:path|to|href|as|route|src)=(?:\"[^\"]*\"|'[^']*'|\{\s*[\"'][^\"']*[\"']\s*\}))")
    values = F.transform(found, lambda s: _part(s, r"=\{?\s*[\"']([^\"']*)[\"']"))
    return sorted_set(F.filter(values, lambda v: v.rlike(r"(?i)^/[a-z0-9\-_/:.]*$")))


def state(text: Text) -> Column:
    """[name, type] of each useState pair: what stands in < up to the first >, else what the initial value shows."""
    found = _all(Source.of(text).code, rf"(\[\w+\s*+,[^\]\n]*+\]\s*+=\s*+useState(?:{GENERIC})?+(?=\(){NEST_CODE})")
    return F.transform(found, lambda s: F.struct(_part(s, r"\[(\w+)").alias("name"), state_type(s).alias("type")))


def state_type(call: Column) -> Column:
    generic, value = _part(call, r"useState<([^>]+)>"), F.trim(_part(call, r"useState\(([^)]+)\)"))
    return (
        F.when(generic != "", generic).when(value.isin("true", "false"), "boolean").when(value.rlike(r"^\d+$"), "number")
        .when(value.rlike("^[\"']"), "string").when(value == "null", "null").when(value == "[]", "array").when(value == "{}", "object").otherwise("unknown")
    )


# ---- Vue --------------------------------------------------------------------------------------------------------------


def vue_composables(text: Text) -> Column:
    called = all_of(Source.of(text).bare, rf"(?<![\w.$])(?<!function )([A-Za-z]\w*+)\s*+(?:{GENERIC}\s*+)?+\(")
    return F.filter(called, lambda n: n.rlike("^use[A-Z]") | n.isin(*VUE_BUILTINS))


def vue_components(text: Text) -> Column:
    """Tags with a capital and the keys of registered components."""
    bodies = _all(Source.of(text).bare, r"\bcomponents\s*(?::|=)\s*\{([^}]*)\}")
    keys = F.transform(F.flatten(F.transform(bodies, lambda b: F.split(b, ","))), lambda s: _part(s, r"^\s*(\w+)"))
    return sorted_set(F.concat(components(text), F.filter(keys, lambda k: k != "")))


def vue_state(text: Text) -> Column:
    """name, type as function<type>; the type argument, else what the first argument shows, else unknown."""
    found = _all(Source.of(text).code, rf"(?:const|let|var)\s+(\w+\s*+=\s*+(?:ref|reactive|computed|shallowRef|shallowReactive)(?:{GENERIC})?+\([^)\n]*+)")

    def one(s: Column) -> Column:
        kind = F.coalesce(_or_null(_part(s, r"=\s*\w+<(.*)>\(")), literal_type(F.trim(_part(s, r"\((.*)$"))), F.lit("unknown"))
        return F.struct(_part(s, r"^(\w+)").alias("name"), F.concat(_part(s, r"=\s*(\w+)"), F.lit("<"), kind, F.lit(">")).alias("type"))

    return F.transform(found, one)


def vue_runtime_type(kind: Column) -> Column:
    mapped = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), VUE_TYPES.items(), F)
    element = _part(kind, r"Array\s*as\s*\(\)\s*=>\s*(\w+)\[\]")
    of_element = reduce(lambda c, kv: c.when(element == kv[0], kv[1]), VUE_TYPES.items(), F).otherwise("any")
    return mapped.when(element != "", F.concat(of_element, F.lit("[]"))).otherwise(kind)


def vue_props(text: Text) -> Column:
    """name, type, optional of defineProps: the type argument's members, else the keys of the runtime object."""
    code = Source.of(text).code
    typed = members(inside(_part(code, rf"defineProps<\s*+(?=\{{)({NEST_CODE})\s*+>")))
    runtime = pieces(inside(_part(code, rf"defineProps\(\s*+(?=\{{)({NEST_CODE})\s*+\)")))
    runtime = F.filter(runtime, lambda m: m.rlike(r"^\s*\w+\s*:"))
    of_value = F.transform(runtime, lambda m: F.struct(
        _part(m, r"^\s*(\w+)").alias("name"), vue_runtime_type(F.trim(F.when(m.rlike(r"^\s*\w+\s*:\s*\{"), _part(m, r"type\s*:\s*([^,}\n]+)")).otherwise(_part(m, r"(?s):\s*(.*)$")))).alias("type"),
        (~m.rlike(r"required\s*:\s*true")).alias("optional"),
    ))
    return F.array_sort(F.concat(typed, of_value))


def vue_emits(text: Text) -> Column:
    """name, signature of defineEmits, in the form of call signatures or of an array of names."""
    code = Source.of(text).code
    typed = _all(_part(code, rf"defineEmits({GENERIC})\("), r"(\(e:\s*['\"][^'\"]+['\"][^)]*\)\s*:\s*void)")
    listed = _all(_part(code, r"defineEmits\(\s*\[([^\]]*)\]"), r"['\"]([^'\"]+)['\"]")

    def one(s: Column) -> Column:
        name, args = _part(s, r"['\"]([^'\"]+)['\"]"), F.trim(_part(s, r"['\"][^'\"]+['\"]\s*,?([^)]*)\)"))
        return F.struct(name.alias("name"), F.concat(F.lit("(e: '"), name, F.when(args != "", F.concat(F.lit("', "), args)).otherwise("'"), F.lit(") => void")).alias("signature"))

    plain = F.transform(listed, lambda n: F.struct(n.alias("name"), F.concat(F.lit("(e: '"), n, F.lit("') => void")).alias("signature")))
    return F.concat(F.transform(typed, one), plain)


def has_vue_composables(text: Text) -> Column:
    return Source.of(text).code.rlike(r"\b(?:ref|reactive|computed|watch|watchEffect|onMounted|onUnmounted)\s*\(|\b(?:defineProps|defineEmits)\s*[(<]")


def has_vue_registration(text: Text) -> Column:
    return Source.of(text).code.rlike(r"defineComponent\s*\(|components\s*:\s*\{|<script\s+setup")


# ---- back ends --------------------------------------------------------------------------------------------------------

ROUTE = "array<struct<method:string,path:string,handler:string,params:array<string>>>"


def _route(method: Column, path: Column, handler: Column) -> Column:
    return F.struct(F.upper(method).alias("method"), path.alias("path"), handler.alias("handler"), _all(path, r":(\w+)").alias("params"))


def express_routes(text: Text) -> Column:
    """method, path, handler, params of app and router calls; a handler that is no plain name is anonymous."""
    found = _all(Source.of(text).code, r"\b((?:app|router)\.(?:get|post|put|delete|patch|all)\(\s*(?:'[^']*'|\"[^\"]*\"|`[^`]*`)\s*,\s*[^,)\s]*[\s]*[,)]?)")

    def one(s: Column) -> Column:
        handler = _or_null(_part(s, r"['\"`]\s*,\s*([A-Za-z_$][\w$]*)\s*[,)]$"))
        return _route(_part(s, r"\.(\w+)\("), _part(s, r"\(\s*['\"`]([^'\"`]*)['\"`]"), F.coalesce(handler, F.lit("anonymous")))

    return F.transform(found, one)


def nest_controller(text: Text) -> Column:
    """name, base path and routes of the first controller class; null without one."""
    body = _part(Source.of(text).code, r"(?s)(@Controller\(.*?)(?:\n\}|\z)")
    found = _all(body, r"(@(?:Get|Post|Put|Delete|Patch)\([^)]*\)(?:\s*@\w+\([^)]*\))*\s*(?:public\s+|async\s+)*\w+\s*\()")
    routes = F.transform(found, lambda s: _route(_part(s, r"@(\w+)"), _part(s, r"@\w+\(\s*['\"`]([^'\"`]*)"), _part(s, r"(\w+)\s*\($")))
    name, base = _part(body, r"class\s+(\w+)"), _or_null(_part(body, r"@Controller\(\s*['\"`]([^'\"`]*)"))
    return F.when(body != "", F.struct(name.alias("name"), base.alias("base_path"), routes.alias("routes")))


def backend(imports_of: Column, text: Text) -> Column:
    code = Source.of(text).code
    express = F.exists(imports_of, lambda i: i == "express") & code.rlike(r"\b(?:app|router)\.(?:get|post|put|delete|patch|all)\s*\(")
    nest = F.exists(imports_of, lambda i: i.startswith("@nestjs")) & code.rlike(r"@(?:Controller|Get|Post|Put|Delete|Patch)\s*\(")
    return F.when(express, "express").when(nest, "nest")


_RETURNS = rf"\s*+:\s*+(?:\{{[^{{}}]*+\}})?+(?:[\w$.\[\] |&'\"]++|{GENERIC})*+"
_MODIFIERS = r"(?:(?:public|private|protected|static|async|override)\s++)*+"
CALLABLE = "array<struct<name:string,parameters:array<struct<name:string,type:string>>,return_type:string>>"
API = "struct<parameters:array<struct<name:string,type:string>>,return_type:string>"


def callables(text: Text) -> Column:
    """name, parameters (name, type) and return type, as declared, of functions, variables that hold one, and methods.

    A parameter without a type is any; what decorates it is left out. Without a declared return type there is none.
    """
    code = Source.of(text).code
    heads = [
        rf"\bfunction\s*+\*?\s*+(?=\w)", rf"\b(?:const|let|var)\s++(?=\w++\s*+(?::[^=\n]++)?+=\s*+(?:async\b\s*+)?(?:function\b|{GENERIC}|\())", rf"(?m)^[ \t]++{_MODIFIERS}(?=\w++\s*+[(<])",
    ]
    between = rf"\s*+(?::[^=\n]++)?+(?:=\s*+(?:async\b\s*+)?(?:function\b\s*+\w*+)?+)?+\s*+(?:{GENERIC})?+"
    ends = ["", "", r"\s*+\{"]
    found = F.concat(*[_all(code, rf"{h}(\w++{between}(?=\(){NEST_CODE}(?:{_RETURNS})?+){e}") for h, e in zip(heads, ends)])

    def one(f: Column) -> Column:
        given = _part(f, rf"^\w++{between}(?=\()({NEST_CODE})")
        plain = F.transform(F.filter(pieces(inside(given)), lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(p, rf"^\s*+(?:@\w++(?:{NEST_CODE})?+\s*+)*+(?:(?:public|private|protected|readonly)\s++)*+", ""))
        kind = lambda p: F.coalesce(_or_null(F.trim(_part(p, r"(?s)^[^:=]*:\s*((?:[^=]|=>)++)"))), F.lit("any"))
        returned = _or_null(F.trim(_part(F.regexp_replace(f, rf"^\w++{between}(?=\(){NEST_CODE}", ""), r"(?s)^\s*:\s*(.*)$")))
        each = F.transform(plain, lambda p: F.struct(_part(p, r"^(?:\.\.\.)?([\w$]+)").alias("name"), kind(p).alias("type")))
        return F.struct(_part(f, r"^(\w+)").alias("name"), each.alias("parameters"), returned.alias("return_type"))

    return F.transform(F.filter(found, lambda f: ~_part(f, r"^(\w+)").isin(*NO_CALL)), one)


def api_signature(routes: Column, known: Column) -> Column:
    """parameters and return type of all routes of a file together; known as of callables(), met by the handler's name.

    A path parameter has the type that its handler gives, the last that does, else string; other parameters of handlers the
    first type that is no string. The return type is the first there is. Null if no route has either.
    """
    met = F.transform(routes, lambda r: F.struct(r["params"].alias("params"), F.get(F.filter(known, lambda c: c["name"] == r["handler"]), F.lit(0)).alias("c")))

    def joined(ms: Column) -> Column:
        given = F.flatten(F.transform(ms, lambda m: F.coalesce(m["c"]["parameters"], F.array().cast("array<struct<name:string,type:string>>"))))
        of_path = F.flatten(F.transform(ms, lambda m: F.filter(F.coalesce(m["c"]["parameters"], F.array().cast("array<struct<name:string,type:string>>")), lambda p: F.array_contains(m["params"], p["name"]))))
        names = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(ms, lambda m: m["params"])), F.transform(given, lambda p: p["name"]))))

        def kind(n: Column) -> Column:
            last = F.try_element_at(F.filter(of_path, lambda p: p["name"] == n), F.lit(-1))["type"]
            other = F.get(F.filter(given, lambda p: (p["name"] == n) & (p["type"] != "string")), F.lit(0))["type"]
            return F.coalesce(last, other, F.lit("string"))

        returned = F.get(F.filter(F.transform(ms, lambda m: m["c"]["return_type"]), lambda x: x.isNotNull()), F.lit(0))
        out = F.struct(F.transform(names, lambda n: F.struct(n.alias("name"), kind(n).alias("type"))).alias("parameters"), returned.alias("return_type"))
        return F.when((F.size(names) > 0) | returned.isNotNull(), out)

    return let(met, joined)


def annotations(text: Text) -> Column:
    """Annotations @X( in order of appearance, repeats kept."""
    return F.transform(_all(Source.of(text).code, r"@(\w+)\("), lambda n: F.concat(F.lit("@"), n))


def route_calls(text: Text) -> Column:
    """Calls that make routes, as @app.get and so on, in order of appearance."""
    return F.transform(_all(Source.of(text).code, r"\b((?:app|router)\.(?:get|post|put|delete|patch|all))\("), lambda n: F.concat(F.lit("@"), n))


# ---- Next.js ----------------------------------------------------------------------------------------------------------


def directive(text: Text) -> Column:
    """client or server, if the first of the first five lines that is no comment says so."""
    lines = F.transform(F.slice(F.split(Source.of(text).text, "\n", 6), 1, 5), F.trim)
    first = F.get(F.filter(lines, lambda s: (s != "") & ~s.startswith("//") & ~s.startswith("/*")), F.lit(0))
    return _or_null(_part(first, r"^['\"]use (client|server)['\"];?$"))


def in_app_dir(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"(^|/)app/")


def route_role(path: Column) -> Column:
    """Role of a file of an app directory, by its base name."""
    return F.when(in_app_dir(path), _or_null(_part(path, r"(?:^|/)(page|layout|loading|error|not-found|template|default|route)(?:\.tsx?)*$")))


def segment_path(path: Column) -> Column:
    """URL path of an app-directory file; route groups in parentheses go. Null outside one."""
    inner = _part(F.replace(path, F.lit("\\"), F.lit("/")), r"(?:^|/)app(/.*)$")
    folders = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"/[^/]*$", ""), r"/\([^)]+\)", ""), "^/+|/+$", "")
    return F.when(inner != "", F.concat(F.lit("/"), folders))


def literal_json(value: Column) -> Column:
    """JSON of a literal: strings, numbers, true, false and null as they are; what is no literal is named by its kind in brackets."""
    v = F.trim(F.regexp_replace(value, r"^\s++|\s++$", ""))
    text = F.regexp_replace(F.regexp_replace(inside(v), r"\\(['\"`])", "$1"), r"\\n", "\n")
    return (
        F.when(v.rlike(rf"^(?:{DOUBLE}|{SINGLE})$"), json_string(text)).when(v.rlike(r"^\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), v).when(v.isin("true", "false", "null"), v)
        .when(v.startswith("["), F.lit('"[array]"')).when(v.startswith("{"), F.lit('"[object]"')).when(v.startswith("`"), F.lit('"[template]"')).otherwise(F.lit('"[expression]"'))
    )


def metadata(text: Text) -> Column:
    """static: JSON of an exported metadata constant, its literal members by name, or a mark that there is one; dynamic: whether a function makes it."""
    code = Source.of(text).code
    found = _part(code, rf"(?m)^\s*+export\s+const\s+metadata\b\s*+(?::[^=]++)?+=\s*+((?=\{{){NEST_CODE}|[^\s;]++)")
    member = r"(?s)^\s*+([\w$]++|\"[^\"\n]++\"|'[^'\n]++')\s*+:(.*)$"

    def whole(found: Column) -> Column:
        given = F.transform(F.filter(pieces(inside(found)), lambda m: m.rlike(member)), lambda m: F.struct(F.regexp_replace(_part(m, member, 1), "^['\"]|['\"]$", "").alias("name"), _part(m, member, 2).alias("value")))
        literal = let(given, lambda g: F.when(F.size(g) > 0, record(g, "name", lambda m: literal_json(m["value"]))))
        return F.when(found != "", F.coalesce(F.when(found.startswith("{"), literal), F.lit('{"_hasMetadata":true}')))

    dynamic = F.exists(Source.of(text).statements, lambda x: x.rlike(r"^export\s+(?:async\s+)?function\s+generateMetadata\b|^export\s+const\s+generateMetadata\b"))
    return F.struct(let(found, whole).alias("static"), dynamic.alias("dynamic"))


# ---- rules ------------------------------------------------------------------------------------------------------------


def kind(text: Text, path: Column, imports_of: Column, hooks_of: Column, components_of: Column) -> Column:
    """Kind of a file, first rule that fits."""
    text = Source.of(text)
    jsx = has_jsx(text)
    some = lambda p: F.exists(imports_of, lambda i: i.rlike(p))
    bare = (F.size(components_of) == 0) & ~jsx & exported_hook(text)
    react = jsx | text.code.rlike(r"React\.createElement|React\.(?:FC|FunctionComponent|ReactElement)|:\s*JSX\.Element")
    return (
        F.when(backend(imports_of, text).isNotNull(), "node:api").when(some("^vue(/|$)") & bare, "vue:composable")
        .when(some("^vue(/|$)") & (has_vue_composables(text) | has_vue_registration(text) | (F.size(components_of) > 0)), "vue:component")
        .when(bare, "react:hook").when((F.size(hooks_of) > 0) | (F.size(components_of) > 0), "react:component")
        .when(some("^react(/|$)") & react, "react:component").when(F.replace(path, F.lit("\\"), F.lit("/")).contains("/cli/") | text.code.contains("process.argv"), "node:cli").otherwise("ts:module")
    )


# What a module or a component is by words in its name, in order, and what it is otherwise.
MODULE_WORDS = [(("util", "helper"), "Utility module"), (("config",), "Configuration module"), (("type", "interface"), "Type definitions")]
COMPONENT_WORDS = [
    (("button",), "Interactive button component"), (("form",), "Form component with validation"), (("modal", "dialog"), "Modal/dialog component"),
    (("input", "field"), "Form input field"), (("card",), "Card display component"), (("nav", "menu"), "Navigation component"),
]
KINDS = {"cli": "CLI entry point", "module": "TypeScript module", "hook": "Custom React hook"}
BY_FACETS = {"both": "Interactive component with internal state", "state": "Stateful component", "events": "Interactive component", "none": "Presentational component"}
# Predictions in order, each with the hooks it is made of and the parts of names of hooks, functions or state.
PREDICTIONS = [
    ("Includes form validation logic", ("useForm",), {"functions": ("validate",)}), ("Has side effects managed by useEffect", ("useEffect",), {}),
    ("Fetches or mutates external data", (), {"hooks": ("Query", "Mutation"), "functions": ("fetch", "load")}), ("Uses memoization for performance optimization", ("useMemo", "useCallback"), {}),
    ("Consumes React Context for shared state", ("useContext",), {}), ("Uses refs for DOM access or mutable values", ("useRef",), {}),
    ("Manages loading/pending UI states", (), {"state": ("loading", "pending")}), ("Handles and displays error states", (), {"state": ("error",)}),
]
# Presets with the events they allow, and the messages of what they forbid or want.
PRESET_EVENTS = {"submit-only": ["onSubmit"], "nav-only": ["onClick"], "display-only": []}
PRESET_MESSAGES = {
    "submit-only": "Submit-only contract violated: remove events", "nav-only": "Nav-only contract violated: remove events", "nav-only wants": "Nav-only contract expects an onClick navigation handler",
    "display-only": "Display-only contract violated: no events permitted, found", "display-only state": "Display-only contract should minimize internal state, found",
}
# What each preset predicts, with the rule that must hold (none: always), and the names that the rules look for.
PRESET_PREDICTIONS = {
    "submit-only": [
        ("", "Contract preset: submit-only"), ("submits", "When loading=true, submit button should be disabled"), ("submits", "onSubmit is the only permitted action handler"),
        ("loads", "Loading state controls button disabled state"),
    ],
    "nav-only": [("", "Contract preset: nav-only"), ("", "Component handles navigation only, no form submission or data mutation"), ("leads", "Navigation target specified via href/to prop")],
    "display-only": [("", "Contract preset: display-only"), ("", "Component is purely presentational with no event handlers"), ("", "All behavior driven by props only")],
}
LOADING, TARGETS = ("loading", "busy", "isLoading"), ("href", "to")


def _by_words(low: Column, words: list[tuple[tuple[str, ...], str]], otherwise: Column | str) -> Column:
    return reduce(lambda c, w: c.when(reduce(lambda a, b: a | b, [low.contains(x) for x in w[0]]), w[1]), words, F).otherwise(otherwise)


def description(path: Column, kind_of: Column, has_state: Column, has_events: Column) -> Column:
    """What a file is, by its kind and the words in its name, then by state and events."""
    name = F.coalesce(_or_null(_part(path, r"([^/]*?)(?:\.tsx?)?$")), F.lit("Component"))
    low = F.lower(name)
    by_facets = F.when(has_state & has_events, BY_FACETS["both"]).when(has_state, BY_FACETS["state"]).when(has_events, BY_FACETS["events"]).otherwise(BY_FACETS["none"])
    what = (
        F.when(kind_of == "node:cli", KINDS["cli"]).when(kind_of == "ts:module", _by_words(low, MODULE_WORDS, KINDS["module"])).when(kind_of == "react:hook", KINDS["hook"])
        .otherwise(_by_words(low, COMPONENT_WORDS, by_facets))
    )
    return F.concat(name, F.lit(" - "), what)


def predictions(hooks_of: Column, functions_of: Column, state_names: Column) -> Column:
    """What the names of hooks, functions and state let expect; independent rules, in fixed order."""
    named = {"hooks": hooks_of, "functions": functions_of, "state": state_names}
    like = lambda items, words: F.exists(items, lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in words]))

    def holds(exact: tuple[str, ...], parts: dict) -> Column:
        rules = [like(named[k], words) for k, words in parts.items()] + ([F.exists(hooks_of, lambda h: h.isin(*exact))] if exact else [])
        return reduce(lambda a, b: a | b, rules)

    return F.array_compact(F.array(*[F.when(holds(exact, parts), text) for text, exact, parts in PREDICTIONS]))


def preset_violations(preset: str, event_names: Column, state_names: Column) -> Column:
    """Messages for what a contract preset (submit-only, nav-only, display-only, none) forbids or wants."""
    allowed = PRESET_EVENTS.get(preset)
    if allowed is None:
        return F.array().cast("array<string>")
    other = F.filter(event_names, lambda e: ~e.isin(*allowed)) if allowed else event_names
    named = lambda text, items: F.when(F.size(items) > 0, F.concat(F.lit(text + " ["), F.array_join(items, ", "), F.lit("]")))
    rules = [named(PRESET_MESSAGES[preset], other)]
    if preset == "nav-only":
        rules.append(F.when(~F.array_contains(event_names, "onClick"), PRESET_MESSAGES["nav-only wants"]))
    if preset == "display-only":
        rules.append(named(PRESET_MESSAGES["display-only state"], state_names))
    return F.array_compact(F.array(*rules))


def preset_predictions(preset: str, event_names: Column, state_names: Column, prop_names: Column) -> Column:
    """What a contract preset lets expect of a file with these events, state and props, in fixed order; empty for none."""
    texts = PRESET_PREDICTIONS.get(preset)
    if texts is None:
        return F.array().cast("array<string>")
    holds = {
        "": F.lit(True), "submits": F.array_contains(event_names, "onSubmit"), "loads": F.arrays_overlap(state_names, F.array(*map(F.lit, LOADING))),
        "leads": F.arrays_overlap(prop_names, F.array(*map(F.lit, TARGETS))),
    }
    return F.array_compact(F.array(*[F.when(holds[rule], text) for rule, text in texts]))


PROP = "array<struct<name:string,type:string,optional:boolean,literals:array<string>,signature:string>>"


def contracts(sources: DataFrame) -> DataFrame:
    """sources(path, text) to one contract row per file: composition, interface, exports, kind and description, routes, error.

    A file of a server framework has routes and no hooks, components, state, props or events; one that imports Vue has those
    of Vue; all others are read as React. Each text is scanned once, and no form of text throws: a facet that cannot be read
    is empty. A null text gives null facets and says so in error.
    """
    made, t = scanned(sources)
    p = F.col("path")
    made = made.withColumns({"imports": imports(t), "functions": functions(t), "variables": variables(t), "exports": exports(t)})
    out = made.withColumn("framework", backend(F.col("imports"), t))
    vue = F.exists("imports", lambda i: (i == "vue") | i.startswith("vue/"))

    def facet(of_vue: Column, of_react: Column, kind: str) -> Column:
        return F.when(F.col("framework").isNotNull(), F.array().cast(kind)).when(vue, of_vue.cast(kind)).otherwise(of_react.cast(kind))

    def typed(m: Column) -> Column:
        q = prop_type(m["type"], m["optional"])
        return F.struct(m["name"].alias("name"), q["type"].alias("type"), q["optional"].alias("optional"), q["literals"].alias("literals"), q["signature"].alias("signature"))

    out = out.withColumns({
        "hooks": facet(vue_composables(t), hooks(t), "array<string>"), "components": facet(vue_components(t), components(t), "array<string>"),
        "state": facet(vue_state(t), state(t), "array<struct<name:string,type:string>>"), "props": facet(F.transform(vue_props(t), typed), props(t), PROP),
    })
    out = out.withColumns({"emits": facet(vue_emits(t), events(t, F.col("props")), "array<struct<name:string,signature:string>>"), "kind": kind(t, p, F.col("imports"), F.col("hooks"), F.col("components"))})
    nest = nest_controller(t)["routes"]
    routes = F.when(F.col("framework") == "nest", nest).when(F.col("framework") == "express", express_routes(t)).otherwise(F.array().cast(ROUTE))
    names = F.transform("state", lambda s: s["name"])
    out = out.withColumns({
        "routes": routes, "controller": F.when(F.col("framework") == "nest", F.struct(nest_controller(t)["name"].alias("name"), nest_controller(t)["base_path"].alias("base_path"))), "decorators": F.when(F.col("framework") == "express", route_calls(t)), "annotations": F.when(F.col("framework") == "nest", annotations(t)),
        "api_signature": F.when(F.col("framework").isNotNull(), api_signature(routes, callables(t))), "description": description(p, F.col("kind"), F.size("state") > 0, F.size("emits") > 0),
        "prediction": predictions(F.col("hooks"), F.col("functions"), names),
        "nextjs": F.when(in_app_dir(p) | directive(t).isNotNull(), F.struct(in_app_dir(p).alias("in_app_dir"), directive(t).alias("directive"), route_role(p).alias("role"), segment_path(p).alias("segment"), metadata(t).alias("metadata"))),
        "error": F.when(F.col("text").isNull(), "no text"),
    })
    return out.drop("text", *VIEWS)
