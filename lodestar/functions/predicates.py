"""Filters as column expressions: names, paths, kinds and ranges."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from lodestar.schema import CATEGORIES, in_category, is_definition

_SPECIAL = re.compile(r"[\\.^$|+()\[\]{}]")


def any_of(conditions: list[F.Column]) -> F.Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[F.Column]) -> F.Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a wildcard pattern: * any run, ? one character."""
    return "^" + _SPECIAL.sub(lambda m: "\\" + m[0], pattern).replace("*", ".*").replace("?", ".") + "$"


def literal_prefix(pattern: str) -> str:
    return re.split(r"[*?]", pattern, maxsplit=1)[0]


def wildcard(name: F.Column, pattern: str, ignore_case: bool = False) -> F.Column:
    """Whole-string wildcard match. The literal part in front is also tested alone, which Parquet statistics can prune by."""
    prefix = literal_prefix(pattern)
    match = name.rlike(("(?i)" if ignore_case else "") + "(?s)" + glob_regex(pattern))
    return match if ignore_case or not prefix else name.startswith(prefix) & match


def matches(name: F.Column, pattern: str, regex: bool = False, ignore_case: bool = False) -> F.Column:
    """Substring by default, or an unanchored regular expression; one that does not compile is taken as a substring."""
    if regex:
        try:
            re.compile(pattern)
            return name.rlike(("(?i)" if ignore_case else "") + pattern)
        except re.error:
            pass
    return F.lower(name).contains(pattern.lower()) if ignore_case else name.contains(pattern)


def prefix(name: F.Column, pattern: str, ignore_case: bool = False) -> F.Column:
    return F.lower(name).startswith(pattern.lower()) if ignore_case else name.startswith(pattern)


def is_function_variable(name: F.Column) -> F.Column:
    """A variable inside a function: its last part follows a closing parenthesis and ``::``."""
    return name.rlike(r"\)::[A-Za-z0-9_~]*$")


def overload(name: F.Column, pattern: str) -> F.Column:
    """A name, or a function of that name with any parameters; not a variable inside such a function."""
    call = name.startswith(pattern) & (F.instr(name, "(") == len(pattern) + 1) & ~is_function_variable(name)
    return (name == pattern) | call


def name_search(
    name: F.Column, pattern: str, *, regex: bool = False, wildcards: bool = False, ignore_case: bool = False, exact_overload: bool = False
) -> F.Column:
    """How a symbol name is searched for: everything for '', a regular expression, a wildcard pattern if it holds one, the overload rule, else a prefix."""
    if not pattern:
        return F.lit(True)
    if regex:
        return matches(name, pattern, True, ignore_case)
    if wildcards and re.search(r"[*?]", pattern):
        return wildcard(name, pattern, ignore_case)
    if exact_overload and not ignore_case:
        return overload(name, pattern)
    return prefix(name, pattern, ignore_case)


def path_filter(path: F.Column, filters: list[str], known_files: frozenset[str] = frozenset(), regex: bool = False, ignore_case: bool = False) -> F.Column:
    """Filters are OR-ed: a known file by equality, else a prefix, or a regular expression."""
    if not filters:
        return F.lit(True)
    if regex:
        return any_of([matches(path, f, True, ignore_case) for f in filters])
    return any_of([path == f if f in known_files else path.startswith(f) for f in filters])


def scan_filter(path: F.Column, globs: list[str]) -> F.Column:
    """Whether a scanned path is filtered: a glob matches or the path contains the filter."""
    return any_of([path.rlike("(?s)" + glob_regex(g)) | path.contains(g) for g in globs])


def line_range(low: int, high: int, line: F.Column | None = None) -> F.Column:
    """Inclusive; the upper end must be greater."""
    if high <= low:
        raise ValueError("a range needs its end above its start")
    return (F.col("line") if line is None else line).between(low, high)


def is_system(path: F.Column, prefixes: tuple[str, ...] = ("/usr/", "/opt/", "/Library/")) -> F.Column:
    return any_of([path.startswith(p) for p in prefixes])


def kind_key(kind: F.Column) -> F.Column:
    return F.lower(F.replace(kind, F.lit(" "), F.lit("")))


def kind_filter(spec: str, kind: F.Column | None = None, flags: F.Column | None = None) -> F.Column:
    """Comma-separated kinds or categories. ``-x`` excludes; ``x+`` only definitions, ``x-`` only others; * and ? are wildcards.

    Excludes are tested first; without an include all kinds pass.
    """
    kind = F.col("kind") if kind is None else kind
    include, exclude = [], []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        suffix = part[-1] if part[-1] in "+-" and len(part) > 1 else ""
        part = part[: len(part) - len(suffix)]
        minus, part = part.startswith("-"), part.lstrip("-").lower().replace(" ", "")
        if part in CATEGORIES:
            hit = in_category(part, kind)
        elif re.search(r"[*?]", part):
            hit = wildcard(kind_key(kind), part)
        else:
            hit = kind_key(kind) == part
        if suffix:
            hit = hit & (is_definition(flags) if suffix == "+" else ~is_definition(flags))
        (exclude if minus else include).append(hit)
    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))


def is_reference(kind: F.Column, linkage: F.Column | None = None, flags: F.Column | None = None) -> F.Column:
    """A reference kind; also an external declaration that neither defines nor is a function."""
    hit = in_category("reference", kind)
    if linkage is not None and flags is not None:
        hit = hit | ((linkage == "External") & ~is_definition(flags) & ~in_category("function", kind))
    return hit


def needs_qualifiers(kind: F.Column) -> F.Column:
    return kind.isin("FunctionDecl", "CXXMethod", "CXXConstructor", "CXXDestructor", "FunctionTemplate", "FieldDecl", "VarDecl", "ClassDecl", "StructDecl", "EnumConstantDecl")


def dead_candidate(kind: F.Column, name: F.Column) -> F.Column:
    """Functions that may be dead: no destructor, no lambda, not main."""
    return in_category("function", kind) & (kind != "CXXDestructor") & (kind != "LambdaExpr") & ~name.startswith("int main(") & ~name.startswith("void main(")


def indexable(path: F.Column, compiler: F.Column, ignored_compilers: list[str], exclude_globs: list[str], root: str = "") -> F.Column:
    """Whether a source takes part: compiler not ignored, path in the root and hit by no exclude glob."""
    keep = ~compiler.isin(ignored_compilers) if ignored_compilers else F.lit(True)
    return keep & ~scan_filter(path, exclude_globs) & path.startswith(root)


def available(availability: F.Column) -> F.Column:
    return availability.isin("Available", "Deprecated")
