"""Facets of three UI libraries in source text: which components are used how often, their variants, patterns and features.

All of it is column expressions within a row: a file's tags and imports are cut once, so that nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.extract import Text, _all, _or_null, _part, sorted_set
from weftline.operators.lexer import STRING, VIEWS, Source, _nest, scanned

# Components of the first library.
MATERIAL = (
    "Accordion Alert AppBar Autocomplete Avatar Backdrop Badge BottomNavigation Box Breadcrumbs Button ButtonGroup Card Checkbox Chip "
    "CircularProgress Container CssBaseline Dialog Divider Drawer Fab FormControl FormGroup FormLabel Grid Icon IconButton Input "
    "InputAdornment InputBase InputLabel LinearProgress Link List ListItem ListItemButton ListItemIcon ListItemText Menu MenuItem "
    "MobileStepper Modal NativeSelect Pagination Paper Popover Popper Radio RadioGroup Rating Select Skeleton Slider Snackbar SpeedDial "
    "Stack Stepper Switch Tab Table TableBody TableCell TableContainer TableFooter TableHead TablePagination TableRow Tabs TextField "
    "ToggleButton ToggleButtonGroup Toolbar Tooltip Typography Zoom"
)
MATERIAL_STYLES = ("@mui/material/styles", "@mui/styles", "@mui/system", "@material-ui/core/styles", "@material-ui/styles")
LEGACY_STYLES = ("@mui/styles", "@material-ui/styles")
SYSTEM_TAGS = ("Box", "Stack", "Grid", "Container")
SYSTEM_PROPS = ("spacing", "color", "bgcolor", "p", "m", "px", "py", "mx", "my", "pt", "pb", "pl", "pr", "mt", "mb", "ml", "mr")
# What the second library's variants and sizes may be, and its import paths.
VARIANTS = {
    "alert": ("default", "destructive"), "badge": ("default", "secondary", "destructive", "outline"),
    "button": ("default", "destructive", "outline", "secondary", "ghost", "link"), "card": (), "other": (),
}
SIZES = ("default", "sm", "lg", "icon", "xs", "xl")
KIT_PATHS = r"^@/components/ui/|^~/components/ui/|^components/ui/|^\.\.?/.*/ui/"
ICONS = r"^lucide-react$|^@radix-ui/react-icons$|^react-icons"
# Attributes that show who holds a primitive's state.
CONTROLLED = ("value", "checked", "open", "pressed")
UNCONTROLLED = ("defaultValue", "defaultChecked", "defaultOpen", "defaultPressed")
# Components of the second and third library are a base and a part of these; no table of all pairs is kept.
PRIMITIVE_BASES = (
    "Dialog AlertDialog Popover Tooltip HoverCard DropdownMenu ContextMenu Menubar NavigationMenu Accordion Collapsible Tabs Checkbox RadioGroup "
    "Select Slider Switch Toggle ToggleGroup Avatar Progress ScrollArea Separator AspectRatio Label Portal VisuallyHidden"
)
KIT_BASES = PRIMITIVE_BASES.replace(" Portal VisuallyHidden", "") + " Alert Badge Button Calendar Card Command Form Input ScrollBar Sheet Skeleton Table Textarea Toast Toaster"
PRIMITIVE_PARTS = (
    "Trigger Portal Overlay Content Title Description Close Action Cancel Anchor Arrow Provider Item CheckboxItem RadioGroup RadioItem Label "
    "Separator Shortcut Group Sub SubContent SubTrigger Menu List Link Indicator Viewport Header Value Icon ItemText ItemIndicator "
    "ScrollUpButton ScrollDownButton Track Range Thumb Image Fallback Scrollbar Corner"
)
KIT_PARTS = PRIMITIVE_PARTS + " Body Caption Cell Control Dialog Empty Field Footer Head Input Message Row"

_BRACES = _nest(6, True)
_VALUE = rf"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|{_BRACES}))?+"
_TAG = rf"{STRING}|(?<![\w$.)\]])(<[A-Za-z][\w$.-]*+(?:\s++|[\w:-]++{_VALUE}|{_BRACES})*+/?>)"
_IMPORT = r"(?:^|[;}\n])\s*+(import\b\s*+(?:[^'\";()]*?\bfrom\s*+)?['\"][^'\"\n]+['\"])"


def _names(bases: str, parts: str = "") -> str:
    return f"^(?:{'|'.join(bases.split())})" + (f"(?:{'|'.join(parts.split())})?" if parts else "") + "$"


def import_list(text: Text) -> Column:
    """One struct per import declaration: module, named (original and local name each), default and namespace (or null)."""

    def name(n: Column) -> Column:
        original = _part(n, r"^\s*(?:type\s+)?([\w$]+)")
        return F.struct(original.alias("original"), F.coalesce(_or_null(_part(n, r"\bas\s+([\w$]+)")), original).alias("local"))

    def one(i: Column) -> Column:
        named = F.filter(F.split(_part(i, r"\{([^{}]*)\}"), ","), lambda n: F.trim(n) != "")
        return F.struct(
            _part(i, r"['\"]([^'\"\n]+)['\"]$").alias("module"), F.transform(named, name).alias("named"),
            _or_null(_part(i, r"^import\s+(?:type\s+(?!from\b))?([\w$]+)\s*(?:,|\bfrom\b)")).alias("default"), _or_null(_part(i, r"\*\s*as\s+([\w$]+)")).alias("namespace"),
        )

    return F.transform(_all(Source.of(text).code, _IMPORT), one)


def tag_list(text: Text) -> Column:
    """One struct per opening tag outside strings: tag as written and its attributes (name, and value if it is a literal)."""

    def attribute(a: Column) -> Column:
        return F.struct(_part(a, r"^([\w:-]+)").alias("name"), F.when(a.rlike(r"[\"']$"), _part(a, r"(?s)=\s*[\"'](.*)[\"']$")).alias("value"), a.alias("text"))

    def one(t: Column) -> Column:
        pairs = _all(F.regexp_replace(t, r"^<[\w$.-]++", ""), rf"{_BRACES}|([\w:-]++{_VALUE})")
        return F.struct(_part(t, r"^<([\w$.-]+)").alias("tag"), F.transform(F.filter(pairs, lambda a: a != ""), attribute).alias("attributes"))

    return F.transform(F.filter(_all(Source.of(text).code, _TAG), lambda t: t != ""), one)


def _ranked(names: Column, top: int) -> Column:
    """Distinct names, the most frequent first, ties in order without case; top of them."""
    counted = F.transform(F.array_distinct(names), lambda d: F.struct((-F.size(F.filter(names, lambda x: x == d))).alias("n"), F.lower(d).alias("low"), d.alias("name")))
    return F.slice(F.transform(F.array_sort(counted), lambda c: c["name"]), 1, top)


def _first(tag: Column) -> Column:
    return F.substring_index(tag, ".", 1)


def _resolved(tags: Column, known: Column, names: str) -> Column:
    """Tags with the component that each stands for: by the local names known(local, original), else by its own name."""
    each = F.transform(tags, lambda t: F.struct(F.coalesce(F.get(F.filter(known, lambda k: k["local"] == _first(t["tag"])), F.lit(0))["original"], _first(t["tag"])).alias("component"), t["attributes"].alias("attributes")))
    return F.filter(each, lambda t: t["component"].rlike(names))


def _calls(bare: Column, *names: str) -> Column:
    return bare.rlike(rf"(?<![\w$.])(?:{'|'.join(names)})\s*+(?:<[^<>()]*+>)?+\(")


def _has(tags: Column, *names: str) -> Column:
    return F.exists(tags, lambda t: F.exists(t["attributes"], lambda a: a["name"].isin(*names)))


def material(t: Source, imports: Column, tags: Column, top: int = 20) -> Column:
    """components by use (imports count too), packages, and whether theme, sx, styled, makeStyles and system props are used.

    Uses count only in a file that imports the library. A default import stands for the last segment of its module.
    """
    names = _names(MATERIAL)
    own = F.filter(imports, lambda i: i["module"].rlike("^@mui/|^@material-ui/"))
    last = lambda i: F.element_at(F.split(i["module"], "/"), -1)
    default = F.transform(F.filter(own, lambda i: i["default"].isNotNull()), lambda i: F.struct(F.when(last(i).rlike(names), last(i)).otherwise(i["default"]).alias("original"), i["default"].alias("local")))
    known = F.filter(F.concat(F.flatten(F.transform(own, lambda i: i["named"])), default), lambda n: n["original"].rlike(names))
    used = F.when(F.size(own) > 0, _resolved(tags, known, names)).otherwise(F.slice(_resolved(tags, known, names), 1, 0))
    some = F.size(own) > 0
    imported = lambda name: F.exists(imports, lambda i: F.exists(i["named"], lambda n: n["original"] == name))
    styled = F.exists(imports, lambda i: i["module"].isin(*MATERIAL_STYLES) & (F.exists(i["named"], lambda n: n["original"] == "styled") | F.coalesce(i["default"] == "styled", F.lit(False))))
    theme = _calls(t.bare, "useTheme", "createTheme") | imported("ThemeProvider") | t.bare.rlike(r"(?<![\w$.])theme\s*+\??\.") | t.code.rlike(r"[\w$)\]>]`[^`]*theme\.")
    return F.struct(
        _ranked(F.concat(F.transform(known, lambda n: n["original"]), F.transform(used, lambda u: u["component"])), top).alias("components"),
        sorted_set(F.transform(own, lambda i: i["module"])).alias("packages"), theme.alias("theme"), (some & _has(tags, "sx")).alias("sx"), (styled | (some & _calls(t.bare, "styled"))).alias("styled"),
        (_calls(t.bare, "makeStyles") | F.exists(imports, lambda i: i["module"].isin(*LEGACY_STYLES))).alias("make_styles"),
        F.exists(used, lambda u: u["component"].isin(*SYSTEM_TAGS) & F.exists(u["attributes"], lambda a: a["name"].isin(*SYSTEM_PROPS))).alias("system_props"),
    )


def kit(t: Source, imports: Column, tags: Column, top: int = 30) -> Column:
    """components by use, variants (type, values), sizes, and whether forms, themes and icons are used; density by distinct ones."""
    names = _names(KIT_BASES, KIT_PARTS)
    own = F.filter(imports, lambda i: i["module"].rlike(KIT_PATHS))
    default = F.transform(F.filter(own, lambda i: i["default"].isNotNull()), lambda i: F.struct(i["default"].alias("original"), i["default"].alias("local")))
    known = F.filter(F.concat(F.flatten(F.transform(own, lambda i: i["named"])), default), lambda n: n["original"].rlike(names))
    used = F.when(F.size(own) > 0, _resolved(tags, known, names)).otherwise(F.slice(_resolved(tags, known, names), 1, 0))
    all_names = F.concat(F.transform(known, lambda n: n["original"]), F.transform(used, lambda u: u["component"]))
    typed = [k for k in VARIANTS if k != "other"]

    def values(kind: str) -> Column:
        of = (lambda u: ~F.lower(u["component"]).isin(*typed)) if kind == "other" else (lambda u: u["component"] == kind.capitalize())
        given = F.flatten(F.transform(F.filter(used, of), lambda u: F.transform(F.filter(u["attributes"], lambda a: (a["name"] == "variant") & a["value"].isNotNull()), lambda a: a["value"])))
        allowed = VARIANTS[kind]
        return F.when(F.size(given) > 0, F.struct(F.lit(kind).alias("type"), sorted_set(F.filter(given, lambda v: v.isin(*allowed)) if allowed else given).alias("values")))

    sizes = F.flatten(F.transform(used, lambda u: F.transform(F.filter(u["attributes"], lambda a: (a["name"] == "size") & a["value"].isin(*SIZES)), lambda a: a["value"])))
    n = F.size(F.array_distinct(all_names))
    theme = _calls(t.bare, "useTheme") | F.exists(imports, lambda i: i["module"].rlike("(?i)theme-provider") | F.exists(i["named"], lambda m: m["original"] == "ThemeProvider"))
    theme |= F.exists(tags, lambda x: F.exists(x["attributes"], lambda a: a["name"].isin("className", "class") & a["text"].rlike("theme-|dark:")))
    form = _calls(t.bare, "useForm", "FormProvider", "Controller") | F.exists(all_names, lambda x: x.isin("Form", "FormField"))
    return F.struct(
        _ranked(all_names, top).alias("components"), F.array_compact(F.array(*[values(k) for k in VARIANTS])).alias("variants"), sorted_set(sizes).alias("sizes"),
        form.alias("form"), theme.alias("theme"), F.exists(imports, lambda i: i["module"].rlike(ICONS)).alias("icons"),
        F.when(n > 0, F.when(n <= 3, "low").when(n <= 8, "medium").otherwise("high")).alias("density"),
    )


def primitives(imports: Column, tags: Column) -> Column:
    """primitives per package (a namespace as ``Name.*``), controlled and uncontrolled ones, portals, asChild, accessibility, depth."""
    names = _names(PRIMITIVE_BASES, PRIMITIVE_PARTS)
    packages = "^@radix-ui/react-(?:" + "|".join(reduce(lambda s, c: s + ("-" + c.lower() if c.isupper() and s else c.lower()), b, "") for b in PRIMITIVE_BASES.split()) + ")$"
    own = F.filter(imports, lambda i: i["module"].rlike(packages))
    package = lambda i: F.substring_index(i["module"], "/", -1)
    base = lambda i: F.replace(F.initcap(F.replace(F.regexp_replace(package(i), "^react-", ""), F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(""))
    of = lambda i: F.concat(F.transform(F.filter(i["named"], lambda n: n["original"].rlike(names) & n["original"].startswith(base(i))), lambda n: n["original"]), F.array_compact(F.array(F.concat(i["namespace"], F.lit(".*")))))
    each = F.filter(F.transform(own, lambda i: F.struct(package(i).alias("package"), of(i).alias("components"))), lambda p: F.size(p["components"]) > 0)
    merged = F.transform(sorted_set(F.transform(each, lambda p: p["package"])), lambda k: F.struct(k.alias("package"), sorted_set(F.flatten(F.transform(F.filter(each, lambda p: p["package"] == k), lambda p: p["components"]))).alias("components")))
    last = lambda tag: F.substring_index(tag, ".", -1)
    whole = lambda tag: F.concat(_first(tag), last(tag))
    component = lambda tag: F.when(tag.rlike(names), tag).when(tag.contains("."), F.when(whole(tag).rlike(names), whole(tag)).when(last(tag).rlike(names), last(tag)))
    holding = lambda attrs: sorted_set(F.filter(F.transform(F.filter(tags, lambda t: F.exists(t["attributes"], lambda a: a["name"].isin(*attrs))), lambda t: component(t["tag"])), lambda c: c.isNotNull()))
    total = F.aggregate(merged, F.lit(0), lambda n, p: n + F.size(p["components"]))
    portals = F.size(F.filter(tags, lambda t: last(t["tag"]).contains("Portal")))
    return F.struct(
        merged.alias("primitives"), holding(CONTROLLED).alias("controlled"), holding(UNCONTROLLED).alias("uncontrolled"), portals.alias("portals"),
        F.aggregate(tags, F.lit(0), lambda n, t: n + F.size(F.filter(t["attributes"], lambda a: a["name"] == "asChild"))).alias("as_child"),
        _has(tags, "dir").alias("direction"), _has(tags, "trapFocus", "restoreFocus").alias("focus"), _has(tags, "loop", "orientation").alias("keyboard"), _has(tags, "modal").alias("modal"),
        total.alias("primitive_count"), F.when(total > 0, F.when((total <= 3) & (portals <= 1), "simple").when((total <= 10) & (portals <= 5), "moderate").otherwise("complex")).alias("depth"),
    )


def ui_libraries(sources: DataFrame) -> DataFrame:
    """sources (text and any columns) with material, kit and primitives instead of the text.

    A file without a library has empty arrays and no density or depth there; a null text gives nulls.
    """
    made, t = scanned(sources)
    made = made.select("*", F.explode(F.array(import_list(t))).alias("_imports"))
    made = made.select("*", F.explode(F.array(tag_list(t))).alias("_tags"))
    i, g = F.col("_imports"), F.col("_tags")
    known = F.col("text").isNotNull()
    out = made.withColumns({"material": F.when(known, material(t, i, g)), "kit": F.when(known, kit(t, i, g)), "primitives": F.when(known, primitives(i, g))})
    return out.drop("text", "_imports", "_tags", *VIEWS)
