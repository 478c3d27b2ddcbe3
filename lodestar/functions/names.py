"""Symbol names, locations and values as column expressions; Arrow UDFs where nesting must be tracked."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestar.schema import DEFINITION

FUNCTION_KINDS = ("FunctionDecl", "CXXMethod", "CXXConstructor", "CXXDestructor", "FunctionTemplate")


def display_name(name: F.Column, kind: F.Column) -> F.Column:
    """Functions without their parameters, everything else as it is."""
    return F.when(kind.isin(*FUNCTION_KINDS), F.substring_index(name, "(", 1)).otherwise(name)


def strip_parentheses(name: F.Column) -> F.Column:
    return F.substring_index(name, "(", 1)


def parse_location(text: F.Column) -> F.Column:
    """struct(path, line, col) of ``path:line:col`` with an optional colon at the end; null if it is none. Colons in the path are kept."""
    pattern = r"^(.*):([0-9]+):([0-9]+):?$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col")))


def format_location(path: F.Column, line: F.Column, col: F.Column) -> F.Column:
    return F.format_string("%s:%d:%d:", path, line, col)


def pack(file_id: F.Column, line: F.Column, col: F.Column) -> F.Column:
    """One long: 22 bits of file, 21 of line, 21 of column, the column highest. Not for sorting."""
    return F.shiftleft(col.cast("long"), 43).bitwiseOR(F.shiftleft(line.cast("long"), 22)).bitwiseOR(file_id.cast("long"))


def unpack(value: F.Column) -> F.Column:
    mask = (1 << 21) - 1
    return F.struct(
        value.bitwiseAND((1 << 22) - 1).cast("int").alias("file_id"),
        F.shiftrightunsigned(value, 22).bitwiseAND(mask).cast("int").alias("line"),
        F.shiftrightunsigned(value, 43).bitwiseAND(mask).cast("int").alias("col"),
    )


def digits(n: F.Column) -> F.Column:
    return F.length(n.cast("string"))


def target_value(kind_code: F.Column, flags: F.Column) -> F.Column:
    """Kind and definition bit in one integer."""
    return kind_code.bitwiseOR(F.when(flags.bitwiseAND(DEFINITION) != 0, 0x1000).otherwise(0))


def severity(code: F.Column) -> F.Column:
    names = ["none", "warning", "error", "fixit", "note", "skipped"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), code + 1)


def language(path: F.Column) -> F.Column:
    """Language by file extension; 'none' if unknown."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    known = {"c": ["c"], "c++": ["cpp", "cc", "cxx", "C", "c++", "cp"], "c-header": ["h"], "c++-header": ["hpp", "hh", "hxx", "H", "h++", "tcc", "txx", "ipp", "inl"], "objective-c": ["m"], "objective-c++": ["mm", "M"]}
    out = F.lit("none")
    for name, exts in known.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def fixit_message(text: F.Column) -> F.Column:
    return F.format_string("did you mean '%s'?", text)


def split_scope(name: str) -> list[str]:
    """Parts between ``::`` outside of <> and ()."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(name):
        c = name[i]
        if c in "<(":
            depth += 1
        elif c in ">)" and depth:
            depth -= 1
        elif depth == 0 and name.startswith("::", i):
            out.append(name[at:i])
            at = i = i + 2
            continue
        i += 1
    return [*out, name[at:]]


_TEMPLATE = re.compile(r"<[^<>]*>")


def _without_templates(s: str) -> str:
    while (t := _TEMPLATE.sub("", s)) != s:
        s = t
    return s


def permutations(name: str) -> list[str]:
    """Every suffix of the scope, with and without template arguments and parameters; an inverted index of names is built of these."""
    parts = split_scope(name)
    out: dict[str, None] = {}
    for i in range(len(parts)):
        suffix = "::".join(parts[i:])
        for s in (suffix, _without_templates(suffix)):
            out[s] = None
            if s.endswith(")") and "(" in s:
                out[s[: s.index("(")]] = None
    return [s for s in out if s]


@F.pandas_udf(ArrayType(StringType()))
def name_permutations(names: pd.Series) -> pd.Series:
    return names.map(lambda n: permutations(n) if n is not None else None)


def template_canonical(usr: F.Column) -> F.Column:
    """Template arguments of a unique id by position: <A, B> becomes <T0, T1>; of nested ones the innermost."""

    def part(p: F.Column) -> F.Column:
        n = F.size(F.filter(F.split(F.substring(p, 2, F.length(p) - 2), ","), lambda a: F.trim(a) != ""))
        args = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("T"), (i - 1).cast("string")))
        return F.when(p.rlike("^<[^<>]*>$"), F.concat(F.lit("<"), F.when(n > 0, F.array_join(args, ", ")).otherwise(""), F.lit(">"))).otherwise(p)

    return F.array_join(F.transform(F.split(usr, "(?=<)|(?<=>)"), part), "")


def type_match(wanted: F.Column, given: F.Column) -> F.Column:
    """2 equal, 1 equal but for const and references, 0 otherwise."""
    bare = lambda t: F.trim(F.regexp_replace(t, r"\bconst\b|&", ""))
    return F.when(wanted == given, 2).when(bare(wanted) == bare(given), 1).otherwise(0)


def overload_choice(calls: DataFrame) -> DataFrame:
    """The overloads that a call may mean: rows (call_id, candidate, position, level) with a :func:`type_match` level an argument.

    Candidates with an argument that matches not at all are out. Those whose arguments all are equal come before those that need a
    conversion; without any match all candidates stay.
    """
    worst = calls.groupBy("call_id", "candidate").agg(F.min("level").alias("worst"))
    best = worst.groupBy("call_id").agg(F.max("worst").alias("best"))
    return worst.join(best, "call_id").where(F.col("worst") == F.col("best")).select("call_id", "candidate")


def shared_root(paths: DataFrame, col: str = "path") -> DataFrame:
    """The longest common directory of all paths, from their least and greatest alone: partial aggregates, one row."""
    ends = paths.agg(F.min(col).alias("a"), F.max(col).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    equal = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
    first = F.array_position(equal, False)
    return ends.select(F.array_join(F.slice(a, 1, F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")), "/").alias("root"))
