"""Column expressions over file paths and module names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = r"\.(?:tsx?|jsx?)$"


def normalize(path: Column) -> Column:
    """Forward slashes, a small drive letter, without ./, doubled slashes and steps up; a leading run of steps up stays unless the path is absolute."""
    path = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    path = F.when(path.rlike("^[A-Za-z]:"), F.concat(F.lower(F.substring(path, 1, 1)), F.substring(path, F.lit(2), F.char_length(path)))).otherwise(path)
    absolute, parts = path.startswith("/"), F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))

    def step(acc: Column, s: Column) -> Column:
        taken = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        back = F.when(taken, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.concat(acc, F.array(s)))
        return F.when(s == "..", back).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"), F.when(path.endswith("/") & (F.size(kept) > 0), "/").otherwise(""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def code_stem(path: Column) -> Column:
    """Base name without .ts, .tsx, .js or .jsx."""
    return F.regexp_replace(base_name(path), CODE, "")


def parent(path: Column) -> Column:
    """Folder with its closing slash; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def third_party(spec: Column) -> Column:
    """Whether a module name is that of a package: no path, no scheme."""
    return ~spec.rlike(r"^[./]") & ~spec.contains(":")


def package_name(spec: Column) -> Column:
    """@scope/name or the first segment; null for paths and schemes."""
    return F.when(third_party(spec), F.nullif(F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1), F.lit("")))


def root_label(p: Column, files: Column | None = None) -> Column:
    """Label of a folder, first rule that fits; null if it is no root. files: base names in the folder."""
    low = F.lower(p)
    app = low.contains("/app") & F.exists(files, lambda f: f.isin("page.tsx", "layout.tsx")) if files is not None else F.lit(False)
    second = F.get(F.split(p, "/"), F.lit(1))
    return (
        F.when(p == ".", "Project Root").when(app, "Next.js App").when(low.startswith("examples/") & low.endswith("/src"), F.concat(F.lit("Example: "), second))
        .when(low.contains("tests/fixtures/") & low.endswith("/src"), "Test Fixture").when(p == "src", "Main Source").when(low.startswith("apps/"), F.concat(F.lit("App: "), second))
    )
