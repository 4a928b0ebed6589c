"""Column expressions shared by the operators.  All run inside the JVM."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REFACTORING = {
    "rename": ["rename", "renamed"],
    "move": ["move", "moved", "relocate"],
    "split": ["split", "divide", "separate"],
    "merge": ["merge", "combine", "consolidate"],
    "extract": ["extract", "refactor"],
}
PROFILES = {"strict": 0.9, "balanced": 0.7, "lenient": 0.5}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def project_id(path: Column | str) -> Column:
    return F.substring(F.sha2(_c(path), 256), 1, 16)


def short_hash(h: Column | str) -> Column:
    return F.substring(_c(h), 1, 7)


def project_name(path: Column | str) -> Column:
    """Last path segment; a trailing slash doesn't count."""
    return F.substring_index(F.regexp_replace(_c(path), "/+$", ""), "/", -1)


def module_path(module: Column | str) -> Column:
    return F.concat(F.replace(_c(module), F.lit("."), F.lit("/")), F.lit(".py"))


def uses_regex(source: Column | str) -> Column:
    return _c(source).rlike(r"\bimport\s+re\b").cast("int")


def line_count(text: Column | str) -> Column:
    """Lines of a text; a newline at the end doesn't open another."""
    t = _c(text)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when(t.endswith("\n"), 0).otherwise(1)).cast("int")


def risk_flag(complexity: Column | str, index: Column | str) -> Column:
    c, i = _c(complexity), _c(index)
    return F.coalesce(c > 10, F.lit(False)) | F.coalesce((i < 65) & (i != 0), F.lit(False))


def undocumented(docstring: Column | str) -> Column:
    return F.coalesce(_c(docstring), F.lit("")) == ""


def node_type(name: Column | str) -> Column:
    n = _c(name)
    first = F.substring(n, 1, 1)
    return F.when(n.contains("."), "method").when((first == F.upper(first)) & (first != F.lower(first)), "class").otherwise("function")


def keyword_events(message: Column | str, keywords: Mapping[str, Sequence[str]] = REFACTORING) -> Column:
    """Array of the event types of which a keyword occurs in the message, in the map's order."""
    text = F.lower(_c(message))
    hits = [F.when(text.rlike("|".join(re.escape(k) for k in kws)), F.lit(name)) for name, kws in keywords.items()]
    return F.array_compact(F.array(*hits))


def excluded(path: Column | str, patterns: Sequence[str], dialect: str = "glob", base: Column | str | None = None) -> Column:
    """Whether a path is excluded.  ``glob`` matches the whole path or the base
    name, ``regex`` searches in it, ``substring`` looks for the text."""
    p = _c(path)
    name = F.substring_index(p, "/", -1) if base is None else _c(base)
    out = F.lit(False)
    for x in patterns:
        match dialect:
            case "glob":
                g = fnmatch.translate(x).replace(r"\z", r"\Z")
                out = out | p.rlike(f"^{g}") | name.rlike(f"^{g}")
            case "regex":
                out = out | p.rlike(x)
            case "substring":
                out = out | p.contains(x)
            case _:
                raise ValueError("dialect must be glob, regex or substring")
    return out


def trend_direction(first: Column | str, second: Column | str) -> Column:
    a, b = _c(first), _c(second)
    return F.when(b > a * 1.2, "increasing").when(b < a * 0.8, "decreasing").otherwise("stable")


def progress(done: Column | str, total: Column | str) -> Column:
    d, t = _c(done), _c(total)
    return F.when(t > 0, (d / t * 100).cast("int")).otherwise(F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in doubles; null where a norm is zero."""
    x, y = _c(a), _c(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def blended(normalized: Column | str, original: Column | str) -> Column:
    return F.lit(0.7) * _c(normalized) + F.lit(0.3) * _c(original)


def threshold_of(profile: Column | str) -> Column:
    out = F.lit(None).cast("double")
    for name, t in PROFILES.items():
        out = F.when(_c(profile) == name, F.lit(t)).otherwise(out)
    return out


def refactor_prompt(name: Column | str) -> Column:
    steps = "1. Compare the implementations listed.\n2. Collect what each of them can do.\n3. Merge them, edge cases included.\n4. Test every present use.\n5. Point all callers to the merged one."
    return F.concat(F.lit("`"), _c(name), F.lit("` has several implementations in this project; merge them into one.\n" + steps))


def bubble_radius(complexity: Column | str) -> Column:
    return F.lit(5) + F.coalesce(_c(complexity), F.lit(0)) / 5


def first_line(text: Column | str) -> Column:
    return F.substring_index(_c(text), "\n", 1)


def renamed(change: Column | str) -> Column:
    """(old, new) of an ``old -> new`` change, else null."""
    c = _c(change)
    return F.when(c.contains(" -> "), F.struct(F.substring_index(c, " -> ", 1).alias("old"), F.substring_index(c, " -> ", -1).alias("new")))
