"""Compile commands: splitting, typing of arguments and parsing into source rows."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Include options by their spelling, longest first.
INCLUDE_OPTIONS = [
    "-iwithprefixbefore", "-iwithprefix", "-iprefix", "-isysroot", "-isystem", "-idirafter", "-iframework", "-iquote", "-include-pch", "-include", "-imacros", "-imultilib", "-cxx-isystem", "-F", "-I",
]

_DEFAULT_IGNORED = ("NDEBUG",)


def split_command(command: str) -> list[str]:
    """Shell-like words; an unbalanced quote falls back to white space."""
    try:
        return shlex.split(command)
    except ValueError:
        return command.split()


@F.pandas_udf(ArrayType(StringType()))
def split_command_line(commands: pd.Series) -> pd.Series:
    return commands.map(lambda c: split_command(c) if c is not None else None)


def include_type(arg: F.Column) -> F.Column:
    """The include option an argument starts with, or null."""
    out = F.lit(None).cast("string")
    for o in reversed(INCLUDE_OPTIONS):
        out = F.when(arg.startswith(o), o).otherwise(out)
    return out


def blocked_removed(arguments: F.Column, blocked: list[str]) -> F.Column:
    """Arguments without the blocked ones; a blocked ``x=`` also takes the argument after it."""
    eats = [b[:-1] for b in blocked if b.endswith("=")]
    plain = [b for b in blocked if not b.endswith("=")]
    previous = lambda i: F.get(arguments, i - 1)
    return F.filter(arguments, lambda a, i: ~a.isin(plain + eats) & ~F.coalesce(previous(i).isin(eats), F.lit(False)))


_SOURCE = re.compile(r"\.(c|cc|cpp|cxx|C|c\+\+|cp|m|mm|M)$")
_LANGUAGE = {"c": "c", "m": "objective-c", "mm": "objective-c++", "M": "objective-c++"}


def parse(command: str | None, directory: str | None) -> list[dict]:
    """The source rows of one compile command: one for each source file on it."""
    words = split_command(command or "")
    if not words:
        return []
    row = {"compiler": words[0], "language": None, "directory": directory or "", "output": None, "standard": None, "defines": [], "includes": [], "arguments": []}
    files, i = [], 1
    here = lambda p: p if p.startswith("/") or not directory else f"{directory.rstrip('/')}/{p}"
    while i < len(words):
        w = words[i]
        value = lambda n, w=w: w[n:] if len(w) > n else (words[i + 1] if i + 1 < len(words) else "")
        step = 1
        if w.startswith("-D"):
            d = value(2)
            step = 1 + (len(w) == 2)
            name, _, v = d.partition("=")
            row["defines"].append({"name": name, "value": v if "=" in d else None})
        elif w in ("-o", "-x"):
            step = 2
            row["output" if w == "-o" else "language"] = here(value(2)) if w == "-o" else value(2)
        elif w.startswith("-std="):
            row["standard"] = w[5:]
            row["arguments"].append(w)
        elif kind := next((o for o in INCLUDE_OPTIONS if w.startswith(o)), None):
            step = 1 + (len(w) == len(kind))
            row["includes"].append({"type": kind, "path": here(value(len(kind)))})
        elif not w.startswith("-") and _SOURCE.search(w):
            files.append(here(w))
        else:
            row["arguments"].append(w)
        i += step
    return [row | {"path": f, "language": row["language"] or _LANGUAGE.get(f.rsplit(".", 1)[1], "c++")} for f in files]


PARSED = (
    "path STRING, compiler STRING, language STRING, directory STRING, output STRING, standard STRING, "
    "defines ARRAY<STRUCT<name: STRING, value: STRING>>, includes ARRAY<STRUCT<type: STRING, path: STRING>>, arguments ARRAY<STRING>"
)


def parse_commands(commands: DataFrame) -> DataFrame:
    """Source rows of a table (directory, command); rows without a source file give none."""

    def run(batches):
        names = [c.split()[0] for c in ["path", "compiler", "language", "directory", "output", "standard", "defines", "includes", "arguments"]]
        for pdf in batches:
            rows = [r for c, d in zip(pdf["command"], pdf["directory"], strict=True) for r in parse(c, d)]
            yield pd.DataFrame(rows, columns=names)

    return commands.select("command", "directory").mapInPandas(run, PARSED)


def normalised_arguments(arguments: F.Column) -> F.Column:
    """Arguments that tell builds apart: optimisation, debug and word-size switches do not count."""
    return F.filter(arguments, lambda a: ~a.rlike(r"^(-g.*|-O.*|-m32|-m64)$"))


def normalised_defines(defines: F.Column) -> F.Column:
    return F.filter(defines, lambda d: ~d["name"].isin(*_DEFAULT_IGNORED))
